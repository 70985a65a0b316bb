"""Lookup tables of codes, vehicles, signals and repairs, as plain data and as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
SYSTEMS = {"P": ("Powertrain", "Groupe motopropulseur"), "C": ("Chassis", "Chassis"), "B": ("Body", "Carrosserie"), "U": ("Network / UDS", "Reseau / UDS")}
CODE_TYPES = {
    "0": ("Generic (SAE standard)", "Generique (standard SAE)"),
    "1": ("Manufacturer-specific", "Specifique constructeur"),
    "2": ("Generic (SAE standard)", "Generique (standard SAE)"),
    "3": ("Manufacturer-specific", "Specifique constructeur"),
}
SUBSYSTEMS = {
    "0": ("Fuel and air metering / auxiliary emission", "Dosage air/carburant et emissions"),
    "1": ("Fuel and air metering", "Dosage air/carburant"),
    "2": ("Fuel and air metering (injector circuit)", "Dosage air/carburant (circuit injecteur)"),
    "3": ("Ignition system or misfire", "Allumage ou rate de combustion"),
    "4": ("Auxiliary emission controls", "Controle des emissions"),
    "5": ("Vehicle speed, idle control, aux inputs", "Vitesse vehicule, ralenti, entrees auxiliaires"),
    "6": ("Computer output circuit", "Circuit de sortie calculateur"),
    "7": ("Transmission", "Transmission / boite de vitesses"),
    "8": ("Transmission", "Transmission / boite de vitesses"),
    "9": ("Transmission", "Transmission / boite de vitesses"),
}
SEVERITIES = {"low": ("Low - monitor", "Faible - a surveiller"), "medium": ("Medium - repair soon", "Moyen - reparer prochainement"), "high": ("High - stop driving", "Eleve - arreter le vehicule")}
#: code: (description en, description fr, likely causes fr, severity)
KNOWN_CODES = {
    "P0300": ("Random / multiple cylinder misfire detected", "Rates de combustion aleatoires sur plusieurs cylindres", ["Bougies usees", "Bobines d'allumage", "Injecteurs encrasses", "Fuite d'admission", "Faible compression"], "high"),
    "P0301": ("Cylinder 1 misfire detected", "Rate de combustion cylindre 1", ["Bougie cylindre 1", "Bobine cylindre 1", "Injecteur cylindre 1"], "high"),
    "P0302": ("Cylinder 2 misfire detected", "Rate de combustion cylindre 2", ["Bougie cylindre 2", "Bobine cylindre 2", "Injecteur cylindre 2"], "high"),
    "P0171": ("System too lean (bank 1)", "Melange trop pauvre (rangee 1)", ["Prise d'air", "Debitmetre d'air defectueux", "Pression carburant faible", "Injecteurs encrasses"], "medium"),
    "P0401": ("Exhaust gas recirculation (EGR) flow insufficient", "Debit vanne EGR insuffisant", ["Vanne EGR encrassee", "Vanne EGR bloquee", "Conduits EGR obstrues", "Capteur de pression differentielle"], "medium"),
    "P0402": ("EGR flow excessive", "Debit vanne EGR excessif", ["Vanne EGR bloquee ouverte", "Capteur DPF defectueux"], "medium"),
    "P2002": ("Diesel particulate filter (DPF) efficiency below threshold", "Efficacite du filtre a particules (FAP) sous le seuil", ["FAP colmate", "Additif FAP epuise", "Capteur de pression differentielle FAP", "Regenerations incompletes"], "medium"),
    "P0420": ("Catalyst system efficiency below threshold (bank 1)", "Efficacite du catalyseur sous le seuil (rangee 1)", ["Catalyseur use", "Sonde lambda defectueuse", "Fuite d'echappement"], "medium"),
    "P0128": ("Coolant thermostat below regulating temperature", "Thermostat sous la temperature de regulation", ["Thermostat bloque ouvert", "Capteur temperature liquide"], "low"),
    "P0016": ("Crankshaft / camshaft position correlation (bank 1)", "Correlation vilebrequin / arbre a cames (rangee 1)", ["Distribution decalee", "Chaine ou courroie distendue", "Capteur arbre a cames", "Dephaseur (VVT)"], "high"),
    "P0113": ("Intake air temperature sensor circuit high input", "Signal capteur temperature d'air d'admission trop haut", ["Capteur IAT defectueux", "Cablage coupe", "Connecteur corrode"], "low"),
    "U0100": ("Lost communication with ECM/PCM", "Perte de communication avec le calculateur moteur", ["Bus CAN coupe", "Calculateur hors tension", "Cablage reseau"], "high"),
}
SEVERITY_ORDER = {"high": 0, "medium": 1, "low": 2, "unknown": 3}
SEVERITY_WEIGHT = {"high": 3, "medium": 2, "low": 1, "unknown": 1}
WMI = {
    "VF1": ("Renault", "France"), "VF3": ("Peugeot", "France"), "VF7": ("Citroen", "France"), "VR1": ("DS Automobiles", "France"), "W0L": ("Opel", "Germany"),
    "WVW": ("Volkswagen", "Germany"), "WAU": ("Audi", "Germany"), "WBA": ("BMW", "Germany"), "WDB": ("Mercedes-Benz", "Germany"), "TMB": ("Skoda", "Czech Republic"),
    "JT": ("Toyota", "Japan"), "JH": ("Honda", "Japan"), "KMH": ("Hyundai", "South Korea"), "KNA": ("Kia", "South Korea"), "ZFA": ("Fiat", "Italy"),
    "1FA": ("Ford", "USA"), "1G": ("General Motors", "USA"), "5YJ": ("Tesla", "USA"),
}
YEARS = {c: 2010 + i for i, c in enumerate("ABCDEFGHJKLMNPRST")}
#: keyword in description or causes, in order of precedence: (effort, least hours, most hours)
EFFORT = {
    "cylindre": ("moyen", 1.0, 2.0), "egr": ("moyen", 1.5, 3.0), "fap": ("eleve", 2.5, 4.0), "catalyseur": ("eleve", 3.0, 5.0),
    "communication": ("variable", 1.0, 4.0), "thermostat": ("faible", 0.5, 1.5), "melange": ("moyen", 1.0, 3.0),
}
#: signal: (least, most, unit)
PHYSICAL_RANGES = {
    "TEMP_ENG": (-40, 150, "degC"), "N": (0, 8000, "rpm"), "N_ENG": (0, 8000, "rpm"), "TQI": (0, 100, "%"), "TQI_TARGET": (0, 100, "%"), "TQI_MIN": (0, 100, "%"),
    "VS": (0, 300, "km/h"), "SLD_VS": (0, 300, "km/h"), "TPS": (0, 100, "%"), "PV_AV_CAN": (0, 100, "%"), "TEMP_FUEL": (-40, 120, "degC"), "BAT_VOLT": (8, 16, "V"),
}
FREEZE_SIGNALS = {"engine_rpm": ["N", "N_ENG"], "vehicle_speed": ["VS", "SLD_VS"], "coolant_temp": ["TEMP_ENG"]}
STATUS_BITS = {
    0x01: "testFailed", 0x02: "testFailedThisOperationCycle", 0x04: "pendingDTC", 0x08: "confirmedDTC", 0x10: "testNotCompletedSinceLastClear",
    0x20: "testFailedSinceLastClear", 0x40: "testNotCompletedThisOperationCycle", 0x80: "warningIndicatorRequested",
}
FREEZE_DIDS = {0xF40C: ("engine_rpm", "rpm"), 0xF405: ("coolant_temp", "degC"), 0xF40D: ("vehicle_speed", "km/h"), 0xF404: ("engine_load", "%"), 0xF411: ("throttle_position", "%")}
BRAND_GLOBS = {
    "hyundai": "hyundai*.dbc", "toyota": "toyota*pt.dbc", "vw": "vw_*.dbc", "volkswagen": "vw_*.dbc", "ford": "ford*pt.dbc",
    "tesla": "tesla*.dbc", "psa": "psa_*.dbc", "peugeot": "psa_*.dbc", "citroen": "psa_*.dbc",
}
DECLINE_MARKERS = [
    "hors de mon domaine", "en dehors de mon domaine", "pas mon domaine", "je ne peux pas répondre", "je ne peux pas vous aider", "outside my scope",
    "outside of my scope", "cannot answer", "je n'ai pas de définition", "je ne dispose pas", "je ne connais pas", "no definition", "i do not have a definition",
    "pouvez-vous préciser", "pourriez-vous préciser", "quel code", "avez-vous", "could you specify", "which fault code",
]
DEGRADED_PREFIX = "Error: the language model is unavailable"


def lookup(values: dict, key: Column, default: str | None = None) -> Column:
    """``values[key]`` by a map literal; for small tables only."""
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    found = F.try_element_at(table, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def known_codes(spark: SparkSession) -> DataFrame:
    rows = [(c, en, fr, causes, sev) for c, (en, fr, causes, sev) in KNOWN_CODES.items()]
    return spark.createDataFrame(rows, "code string, known_en string, known_fr string, causes_fr array<string>, known_severity string")


def manufacturers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, m, c) for k, (m, c) in WMI.items()], "wmi string, manufacturer string, country string")


def physical_ranges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, float(a), float(b), u) for k, (a, b, u) in PHYSICAL_RANGES.items()], "signal string, lo double, hi double, unit string")


def sql_values(name: str, columns: str, rows: list[tuple]) -> str:
    """A SQL common table expression with the rows of a fixed table."""
    quote = lambda v: "NULL" if v is None else ("'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v))
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)})"
