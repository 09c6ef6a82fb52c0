"""Plain restatements of the operators, for small inputs."""

from __future__ import annotations

import json
import re
from collections import defaultdict
from datetime import date, datetime, timezone


def day_of(text):
    if text is None or not text.strip():
        return None
    digits = re.findall(r"\d+", text)
    if len(digits[0]) == 8:
        digits = [digits[0][:4], digits[0][4:6], digits[0][6:]]
    return date(*map(int, digits[:3]))


def interval_versions(rows):
    """rows: (key, value, from, to, recorded) -> {(key, value, from, to)} day by day."""
    by = defaultdict(list)
    for key, value, a, b, at in rows:
        a, b = day_of(a), day_of(b)
        lo, hi = (a.toordinal() if a else 0), (b.toordinal() if b else 10**7)
        if lo < hi:
            by[key].append((lo, hi, at, value))
    out = set()
    for key, spans in by.items():
        cuts = sorted({x for s in spans for x in s[:2]})
        runs = []
        for lo, hi in zip(cuts, cuts[1:]):
            cover = [(s[2], s[3]) for s in spans if s[0] <= lo and hi <= s[1]]
            value = max(cover)[1] if cover else None
            if runs and runs[-1][0] == value:
                runs[-1][2] = hi
            else:
                runs.append([value, lo, hi])
        show = lambda x: "" if x in (0, 10**7) else date.fromordinal(x).isoformat()
        out |= {(key, v, show(lo), show(hi)) for v, lo, hi in runs if v is not None}
    return out


def snapshot_versions(rows):
    """rows: (owner, key, value, name, revision) -> {(owner, key, value, from, to)}."""
    out = set()
    for owner in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == owner]
        revisions = sorted({r[4] for r in own})
        place = {r: i for i, r in enumerate(revisions)}
        held = defaultdict(set)
        for _, key, value, name, rev in own:
            held[key, value, " ".join((name or "").lower().split())].add(place[rev])
        day = lambda i: datetime.fromtimestamp(revisions[i], timezone.utc).date().isoformat() if i < len(revisions) else ""
        for (key, value, _), at in held.items():
            for i in at:
                if i - 1 not in at:
                    j = i
                    while j in at:
                        j += 1
                    out.add((owner, key, value, day(i), day(j)))
    return out


def as_list(x):
    return x if isinstance(x, list) else [] if x is None else [x]


def submission_rows(rows):
    """rows: (cik, fetched_at, payload)."""
    latest = {}
    for cik, at, payload in rows:
        try:
            o = json.loads(payload)
        except (ValueError, TypeError):
            continue
        if isinstance(o, dict) and (cik not in latest or at > latest[cik][0]):
            latest[cik] = (at, o)
    out = set()
    for cik, (_, o) in latest.items():
        out |= {("ticker", cik, i, t) for i, t in enumerate(as_list(o.get("tickers"))) if t is not None}
        out |= {("former_name", cik, i, f["name"]) for i, f in enumerate(as_list(o.get("formerNames"))) if isinstance(f, dict) and isinstance(f.get("name"), str)}
        filings = o.get("filings") or {}
        out |= {("page", cik, i, f["name"]) for i, f in enumerate(as_list(filings.get("files"))) if isinstance(f, dict) and isinstance(f.get("name"), str)}
        recent, seen = filings.get("recent"), set()
        if isinstance(recent, dict):
            cols = [as_list(recent.get(k)) for k in ("accessionNumber", "form", "filingDate")]
            places = list(enumerate(zip(*cols)))
        else:
            places = [(i, (x["accessionNumber"],)) for i, x in enumerate(recent or []) if {"accessionNumber", "form", "filingDate"} <= set(x)]
        for i, (acc, *_) in places:
            acc = (acc or "").replace("-", "")
            if acc and acc not in seen:
                seen.add(acc)
                out.add(("filing", cik, i, acc))
    return out


def accession_rows(rows):
    """rows: (accession, files)."""
    out = set()
    for accession, files in rows:
        parent = accession.replace("-", "")
        for i, f in enumerate(files if files is not None else []):
            out.add(("file", parent, i, f["name"]))
            for j, m in enumerate(f["members"] if f["members"] is not None else []):
                if m["name"] is not None:
                    out.add(("member", f"{parent}/{f['name']}", j, m["name"]))
    return out
