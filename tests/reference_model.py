"""Day-level brute force of the revenue definitions, in plain Python."""

from __future__ import annotations

import calendar as pycal
from collections import defaultdict
from datetime import date, timedelta
from decimal import Decimal


def months(first: date, last: date):
    out, m = [], first
    while m <= last:
        out.append(m)
        m = (m.replace(day=28) + timedelta(days=4)).replace(day=1)
    return out


def month_end(m: date) -> date:
    return m.replace(day=pycal.monthrange(m.year, m.month)[1])


def timeline(subscriptions):
    """id -> (next_start, effective_end) of rows (id, account, start, end, amount, tier)."""
    by_account = defaultdict(list)
    for s in subscriptions:
        by_account[s[1]].append(s)
    out = {}
    for rows in by_account.values():
        rows.sort(key=lambda s: (s[2], s[0]))
        for s, following in zip(rows, rows[1:] + [None]):
            nxt = following[2] if following else None
            ends = [d for d in (s[3], nxt - timedelta(days=1) if nxt else None) if d]
            out[s[0]] = (nxt, min(ends) if ends else None)
    return out


def panel(account_ids, subscriptions, first, last):
    """(account, month) -> (mrr, tier) at the month's last day."""
    ends = timeline(subscriptions)
    by_account = defaultdict(list)
    for s in subscriptions:
        by_account[s[1]].append(s)
    out = {}
    for a in account_ids:
        for m in months(first, last):
            on = month_end(m)
            live = [s for s in by_account[a]
                    if s[2] <= on and (ends[s[0]][1] is None or ends[s[0]][1] >= on)]
            assert len(live) <= 1
            amount = live[0][4] if live and live[0][4] is not None else Decimal(0)
            out[a, m] = (amount, live[0][5] if live else None)
    return out


def kind(prior, current):
    if prior == 0 and current > 0:
        return "new"
    if prior > 0 and current == 0:
        return "churned"
    if current > prior:
        return "expansion"
    return "contraction" if current < prior else "unchanged"


def movements(cells, account_ids, first, last):
    out = {}
    for a in account_ids:
        prior = Decimal(0)
        for m in months(first, last):
            current = cells[a, m][0]
            out[a, m] = (prior, current, kind(prior, current))
            prior = current
    return out


def waterfall(moves, first, last):
    out = {}
    for m in months(first, last):
        rows = [v for (a, mm), v in moves.items() if mm == m]
        flow = {k: sum((c - p for p, c, kk in rows if kk == k), Decimal(0))
                for k in ("new", "expansion", "contraction", "churned")}
        out[m] = (sum((p for p, _, _ in rows), Decimal(0)), flow["new"], flow["expansion"],
                  flow["contraction"], flow["churned"], sum((c for _, c, _ in rows), Decimal(0)))
    return out


def retention(cells, account_ids, subscriptions, first, last):
    """(cohort, months since) -> (size, active)."""
    cohort = {}
    for s in subscriptions:
        m = s[2].replace(day=1)
        cohort[s[1]] = min(cohort.get(s[1], m), m)
    size = defaultdict(int)
    for m in cohort.values():
        size[m] += 1
    out = {}
    for a in account_ids:
        if a not in cohort:
            continue
        c = cohort[a]
        for m in months(first, last):
            if m >= c:
                key = (c, (m.year - c.year) * 12 + m.month - c.month)
                n, active = out.get(key, (size[c], 0))
                out[key] = (n, active + (cells[a, m][0] > 0))
    return out
