"""Posting lists against every request compared with every entry."""

import itertools
import re
import time

import pytest

from gridlark.dataset import Dataset
from gridlark.model import VARIABLES, SimpleVariable, Variable
from gridlark.operators import lookup, postings

ENTRIES = [
    (0, "hourly", 0, 1, 0, False, "Zone A", "Temperature", "C"),
    (0, "hourly", 0, 2, 1, False, "ZONE AB", "temperature", "C"),
    (0, "monthly", 1, 3, 0, False, "Zone B", "Energy", "J"),
    (0, "monthly", 1, 4, 1, False, None, "Energy", ""),
    (0, "monthly", 1, 5, 2, False, "", None, None),
    (0, "sheet", 2, 6, 0, True, "Zone A", None, "C"),
    (1, "hourly", 0, 1, 0, False, "Zone A", "Temperature", "C"),
    (1, "hourly", 0, 7, 1, False, "ÉTAGE aaa", "Température", "°C"),
]


def a_dataset(spark, rows):
    return Dataset.of(spark, variables=spark.createDataFrame(rows, VARIABLES))


def compared(rows, requests, part_match):
    """(req_no, file_id, id) by comparing all with all."""
    out = []
    for n, r in enumerate(requests):
        for row in rows:
            entry = dict(zip(("file_id", "table", "table_pos", "id", "pos", "is_simple", "key", "type", "units"), row, strict=True))
            if entry["is_simple"] != isinstance(r, SimpleVariable):
                continue
            pairs = [(str(v).lower(), (entry[level] or "").lower()) for level, v in r._asdict().items() if v is not None]
            if all(a in b if part_match else a == b for a, b in pairs):
                out.append((n, entry["file_id"], entry["id"]))
    return sorted(out)


def every_request():
    tables, keys, kinds, units = (None, "HOURLY", "month", ""), (None, "zone a", "a", "ne", "zzz", "", "étage"), (None, "TEMPERATURE", "temp", "xy"), (None, "c", "", "J")
    out = [Variable(*x) for x in itertools.product(tables, keys, kinds, units)]
    return out + [SimpleVariable(*x) for x in itertools.product((None, "sheet", "sh"), keys, units)]


@pytest.mark.parametrize("part_match", [False, True])
def test_every_request(spark, part_match):
    requests = every_request()
    ds = a_dataset(spark, ENTRIES)
    want = compared(ENTRIES, requests, part_match)
    assert len(want) >= 60
    found = postings.HeaderIndex(ds.variables).find(requests, part_match)
    assert set(found.columns) == {*ds.variables.columns, "req_no"}
    assert sorted((r["req_no"], r["file_id"], r["id"]) for r in found.collect()) == want
    own = ds.postings
    assert sorted((n, r["file_id"], r["id"]) for n, q in enumerate(requests) for r in own.find(q, part_match)) == want
    assert len(requests) > 100 and sorted((r["req_no"], r["file_id"], r["id"]) for r in lookup.find(ds, requests, part_match).collect()) == want


@pytest.mark.parametrize("part_match", [False, True])
def test_many_requests(spark, monkeypatch, part_match):
    """Beyond the bound nothing of the header's or the requests' size goes to the driver,
    whatever size is guessed; what asks for nothing is the only side that does."""
    monkeypatch.setattr(postings, "BROADCAST", 2)
    requests = every_request()
    ds = a_dataset(spark, ENTRIES)
    asked = spark.createDataFrame(postings.request_rows(requests), postings.REQUESTS)
    found = postings.HeaderIndex(ds.variables).find(asked, part_match)
    assert found._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") == 1
    assert sorted((r["req_no"], r["file_id"], r["id"]) for r in found.collect()) == compared(ENTRIES, requests, part_match)


@pytest.mark.parametrize("part_match", [False, True])
def test_rows_of_a_request_lie_together(spark, monkeypatch, part_match):
    """Many requests of a few conditions go by numbers, each once and with its rows one after
    the other, though the shortest lists are longer than a block."""
    monkeypatch.setattr(postings, "BROADCAST", 5)
    rows = [(0, "hourly", 0, i, i, False, f"Zone {i % 4}", f"Kind {i % 5}", "J") for i in range(20)]
    requests = [Variable(None, f"zone {n % 2}", "kind 3", None) for n in range(40)] + [Variable("none", None, None, None)]
    requests += [Variable("hourly", None, None, None), SimpleVariable(None, None, None)]
    asked = spark.createDataFrame(postings.request_rows(requests), postings.REQUESTS)
    index = postings.HeaderIndex(spark.createDataFrame(rows, VARIABLES))
    want = compared(rows, requests, part_match)
    for block in (3, 100):
        monkeypatch.setattr(postings, "BLOCK", block, raising=False)
        df = index.find(asked, part_match)
        found = [(r["req_no"], r["file_id"], r["id"]) for r in df.collect()]
        assert sorted(found) == want
        assert not re.search("hashpartitioning\\([^)]*want", df._jdf.queryExecution().executedPlan().toString())
        together = [n for n, _ in itertools.groupby(n for n, _, _ in found if n < 40)]
        assert len(together) == len(set(together)) == 40


def test_nothing(spark):
    ds = a_dataset(spark, ENTRIES)
    none = a_dataset(spark, [])
    assert postings.HeaderIndex(ds.variables).find([]).count() == 0
    assert postings.HeaderIndex(none.variables).find([Variable(None, None, None, None)], True).count() == 0
    assert none.postings.find(Variable("a", None, None, None)) == []


def test_requests_with_numbers_of_their_own(spark):
    ds = a_dataset(spark, ENTRIES)
    asked = spark.createDataFrame([(70, False, None, "zone a", None, None), (70_000_000_000, False, None, "zone a", None, None), (5, False, None, "none", None, None), (5, False, None, "zone b", "none", None), (6, False, None, "zone b", None, None), (6, False, None, "zone b", None, None)], postings.REQUESTS)
    found = postings.HeaderIndex(ds.variables).find(asked).collect()
    assert sorted((r["req_no"], r["file_id"], r["id"]) for r in found) == sorted([(n, f, 1) for n in (70, 70_000_000_000) for f in (0, 1)] + [(6, 0, 3)] * 2)


def test_ten_thousand_requests_on_200_000_variables():
    rows = [{"table": "hourly", "is_simple": False, "key": f"ZONE {i:06d}", "type": f"Kind {i % 50}", "units": "J", "id": i} for i in range(200_000)]
    begun = time.monotonic()
    index = postings.Postings(rows)
    assert [r["id"] for n in range(5_000) for r in index.find(Variable("hourly", f"zone {n * 37:06d}", None, "j"))] == [n * 37 for n in range(5_000)]
    found = [[r["id"] for r in index.find(Variable(None, f"e {n * 37:06d}", None, None), True)] for n in range(5_000)]
    assert found == [[n * 37] for n in range(5_000)]
    assert time.monotonic() - begun < 60
