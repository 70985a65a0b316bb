"""Registered queries over the driver's tables and the SQL that checks them."""

from __future__ import annotations

from torquelake.plans import search_agent, vehicle_codes, vehicle_frames, vehicle_signals, vehicle_streams

_PLANS = (vehicle_frames, vehicle_codes, vehicle_signals, search_agent, vehicle_streams)
QUERIES = {k: f for p in _PLANS for k, f in p.QUERIES.items()}
ORACLES = {k: s for p in _PLANS for k, s in p.ORACLES.items()}
