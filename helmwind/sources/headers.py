"""Find the date, close and risk-free columns of a file by their headers."""

from __future__ import annotations

import re

# Accepted headers, compared after normalisation, and units of the risk-free rate.
ALIASES = {
    "date": ["날짜", "일자", "기준일", "기준일자", "거래일", "date", "dates", "tradedate", "datadate"],
    "close": ["종가", "수정종가", "종가지수", "가격", "지수", "close", "closeprice", "adjclose", "price", "px", "pxlast", "index", "indexlevel"],
    "rf": [
        "무위험금리", "무위험수익률", "무위험이자율", "무위험", "금리", "riskfree", "riskfreerate", "rf", "rfrate", "rate", "tbill", "tbillyield", "yield",
    ],
}
RF_UNITS = ("annual_percent", "annual_decimal", "daily")


def normalize_header(name: str) -> str:
    """Lower case without white space, ``_``, ``-`` and ``.``."""
    return re.sub(r"[\s_\-.]", "", str(name)).lower()


def find_column(columns: list[str], role: str, explicit: str | None = None) -> str:
    """The column for a role: the named one, else the first with an alias as its header, else the first that contains one.

    An alias match takes columns in their order. Raises KeyError if nothing fits.
    """
    plain = {c: normalize_header(c) for c in columns}
    if explicit is not None:
        if explicit in columns:
            return explicit
        for c in columns:
            if plain[c] == normalize_header(explicit):
                return c
        raise KeyError(f"no column {explicit!r} for {role}; there are {columns}")
    aliases = [normalize_header(a) for a in ALIASES[role]]
    for c in columns:
        if plain[c] in aliases:
            return c
    for c in columns:
        if any(a in plain[c] for a in aliases):
            return c
    raise KeyError(f"no {role} column among {columns}")
