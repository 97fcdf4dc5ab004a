"""The order rules against plain Python, row by row, in the order in which rows arrived."""

import datetime
import re
from decimal import Decimal

from tessera.operators import order_quality as oq
from tessera.plans.order_quality import landed


def number(text):
    return Decimal(text.strip()).quantize(Decimal("0.0001")) if text is not None and re.fullmatch(r"[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)", text.strip()) else None


def moment(text):
    try:
        return datetime.datetime.strptime(text, "%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return None


def broken_rules(row, seen, now):
    """Codes of the rules that a row breaks; seen: order ids so far."""
    n = {c: number(row[c]) for c in ("quantity", "unit_price", "amount")}
    unread = lambda c: row[c] is not None and n[c] is None
    name, _, domain = (row["customer_email"] or "").partition("@")
    address = re.fullmatch("[A-Za-z0-9._%+-]+", name) and re.fullmatch("[A-Za-z0-9.-]+[.][A-Za-z]{2,}", domain)
    again = row["order_id"] is not None and row["order_id"] in seen
    seen.add(row["order_id"])
    told = [
        any(row[c] is None for c in oq.REQUIRED), unread("quantity"), n["quantity"] is not None and n["quantity"] <= 0, unread("unit_price"), unread("amount"), n["amount"] is not None and n["amount"] <= 0,
        None not in n.values() and abs(n["amount"] - n["quantity"] * n["unit_price"]) > Decimal("0.01"), row["customer_email"] is not None and not address,
        row["order_ts"] is not None and (moment(row["order_ts"]) is None or moment(row["order_ts"]) > now), row["order_status"] is not None and row["order_status"] not in oq.STATES, again,
    ]
    return [code for code, broken in zip(oq.CODES, told, strict=True) if broken]


def test_rules_row_by_row(spark, sf):
    rows = sorted(oq.evaluate(landed(spark, sf)).collect(), key=lambda r: (r.loaded_at, r.source_file, r.source_row))
    seen: set = set()
    assert len({c for r in rows for c in r.failed}) == len(oq.CODES)
    for r in rows:
        assert r.failed == broken_rules(r.asDict(), seen, r.loaded_at), r
