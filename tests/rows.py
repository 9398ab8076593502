"""Rows of two engines in one comparable form."""

import datetime as dt
import math


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return v


def comparable(rows):
    return sorted(str([plain(v) for v in r]) for r in rows)
