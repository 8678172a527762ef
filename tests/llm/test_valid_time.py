"""Valid-time enrichment against a plain simulation of the contract, one batch after the other."""

import math
import random
import zlib
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rillmark.llm import valid_time
from rillmark.llm.queries import QUERIES

SALES = "sale_id long, client_id long, sold_at timestamp, arrived_at timestamp"
CHANGES = "change_id long, client_id long, seq long, op string, valid_at timestamp, source string, segment string, city string, balance double"
BEGIN = datetime(2024, 1, 1)
DELAY = 12 * 3600 * 10**6


def micros(stamp):
    return None if stamp is None else (stamp - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def simulate(sales, changes):
    """Rows of the result, by dictionaries of clients."""
    n = 8
    batch = lambda day: n - 1 if day is None else max(0, min(n - 1, (day - 19723) * n // 152))
    sold, valid = [[] for _ in range(n)], [[] for _ in range(n)]
    for i, client, at, arrived in sales:
        at, arrived = micros(at), micros(arrived)
        sold[batch(None if arrived is None else arrived // 86_400_000_000)].append((i, client, at))
    for i, client, seq, op, at, *_, balance in set(changes):
        if at is not None:
            day = None if i is None else micros(at) // 86_400_000_000 + zlib.crc32(str(i).encode()) % 4
            valid[batch(day)].append((i, client, seq, op, micros(at), balance))
    none = -(10**30)
    mark_sold = mark_valid = -math.inf
    state, waiting, out = {}, [], []
    order = lambda v: tuple(none if x is None else x for x in v[:3]) + (v[3] or "", none if v[4] is None else v[4])

    def emit(sale, k):
        known = state.get(sale[1], []) if sale[1] is not None else []
        fits = [v for v in known if sale[2] is not None and v[0] <= sale[2]]
        out.append(("sale", sale[0], k, len(known), *((fits[-1][2], fits[-1][4], fits[-1][3]) if fits else (None,) * 3)))

    for k in range(n):
        limit = min(mark_sold, mark_valid)
        for i, client, seq, op, at, balance in valid[k]:
            if at < mark_valid:
                out.append(("late", i, k, *(None,) * 4))
            elif client is not None:
                state.setdefault(client, []).append((at, seq, i, op, None if balance is None else math.floor(100 * balance + 0.5)))
        for known in state.values():
            known.sort(key=order)
        ready = [s for s in waiting + sold[k] if s[2] is None or s[2] < limit]
        waiting = [s for s in waiting + sold[k] if not (s[2] is None or s[2] < limit)]
        for sale in ready:
            emit(sale, k)
        for client, known in state.items():
            old = [v for v in known if v[0] <= limit]
            state[client] = old[-1:] + [v for v in known if v[0] > limit]
        mark_sold = max([mark_sold, *(s[2] - DELAY for s in sold[k] if s[2] is not None)])
        mark_valid = max([mark_valid, *(c[4] - DELAY for c in valid[k])])
    for sale in waiting:
        emit(sale, n)
    return Counter(out)


def result(found):
    return Counter(tuple(r) for r in found.select("rec", "id", "batch", "n_held", "change_id", "balance_cents", "op").collect())


def shop(seed, clients, skewed):
    rnd = random.Random(seed)
    who = lambda: rnd.choice([None, 0, 0, 0, 0] if rnd.random() < skewed else list(range(clients)))
    when = lambda: BEGIN + timedelta(seconds=rnd.randrange(152 * 86400), microseconds=rnd.choice([0, 0, 1, 999_999]))
    sales = []
    for i in range(400):
        at = when()
        late = timedelta(hours=rnd.choice([0, 1, 5, 700]))
        sales.append((i if i % 50 else None, who(), rnd.choice([None, at - timedelta(days=40)]) if i % 23 == 0 else at, None if i % 97 == 0 else at + late))
    changes = []
    for i in range(300):
        at = None if i % 71 == 0 else when()
        changes.append((rnd.choice([None, i]) if i % 41 == 0 else i, who(), rnd.choice([None, 0, 1]), rnd.choice(["I", "U", "D", None]), at, "web", "retail", None, rnd.choice([None, 0.005, -12.345, round(rnd.uniform(-999, 9999), 2)])))
    at = BEGIN + timedelta(days=60)
    changes += [(900 + i % 3, 1, 5, "U", at, "web", None, str(i), 7.0) for i in range(6)]  # all order columns tie
    sales.append((999, 1, at + timedelta(hours=1), at + timedelta(hours=2)))
    return sales + sales[:7], changes + changes[:9]


@pytest.mark.parametrize("skewed", [0.0, 0.6])
def test_stream_equals_simulation(spark, monkeypatch, skewed):
    monkeypatch.setattr(valid_time, "HOT", 4)
    monkeypatch.setattr(valid_time, "SLICES", 5)
    monkeypatch.setattr(valid_time, "BUCKET_ROWS", 100)
    sales, changes = shop(3, 12, skewed)
    extra = {c: F.lit("x") for c in ("batch", "bucket", "kind", "at", "cell", "clock", "id", "n")}
    got = valid_time.enrich(spark.createDataFrame(sales, SALES).withColumns(extra), spark.createDataFrame(changes, CHANGES).withColumns(extra))
    assert result(got) == simulate(sales, changes)


def test_empty_tables(spark):
    sales, changes = spark.createDataFrame([], SALES), spark.createDataFrame([], CHANGES)
    assert valid_time.enrich(sales, changes).count() == 0


def test_query_equals_simulation(spark):
    sf = "/root/testdata/sf0.001"
    sales = spark.read.parquet(f"{sf}/sales.parquet").select("sale_id", "client_id", "sold_at", "arrived_at").collect()
    changes = spark.read.parquet(f"{sf}/client_changes.parquet").collect()
    got = result(QUERIES["op13_valid_time"](spark, sf))
    assert got == simulate([tuple(r) for r in sales], [tuple(r) for r in changes])
    assert {k[0] for k in got} == {"sale", "late"}
