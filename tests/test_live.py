"""Live views: equality with the batch result after any changes, second deliveries, values that return, cut-over, leases."""

import datetime as dt
import json
import random
from decimal import Decimal

import pytest

from pricetide import schemas
from pricetide.operators import cart as cartops
from pricetide.operators import hierarchy, pricing
from pricetide.streaming import live

T0 = dt.datetime(2024, 1, 1)
CART = "product_id bigint, product_name string, category_id bigint, price decimal(10,2), ts timestamp_ntz"


def _rows():
    return {
        "products": [(i, f"cheap p{i}" if i % 3 == 0 else f"p{i}", Decimal("10.00"), 100 + i % 3, 1, True, T0) for i in range(1, 19)],
        "sales": [(i, 1 + (i * i) % 17, Decimal("10.0000"), T0 + dt.timedelta(days=i % 30), Decimal(f"{5 + i % 9}.00")) for i in range(150)],
        "promotions": [(1, 2, Decimal("15.00"), T0, T0, True, T0), (2, 2, Decimal("5.00"), T0, T0, False, T0)],
        "inventory": [(i, i, 5 * i, 1, T0) for i in range(1, 16)],
        "shopping_cart": [(p, f"p{p}", 100, Decimal("1.00"), T0) for p in (1, 1, 2, 5, 8, 13)],
        "categories": [(1, "all", None), (2, "other", None), (100, "a", 1), (101, "b", 1), (102, "c", 101)],
    }


SCHEMA = {"products": schemas.PRODUCTS, "sales": schemas.SALES, "promotions": schemas.PROMOTIONS, "inventory": schemas.INVENTORY,
          "shopping_cart": CART, "categories": schemas.CATEGORIES}


def _frames(spark, rows):
    return {n: spark.createDataFrame(r, SCHEMA[n]) for n, r in rows.items()}


def _text(frame_row, names):
    out = {}
    for k, v in zip(names, frame_row):
        out[k] = v.strftime("%Y-%m-%dT%H:%M:%S.%f") if isinstance(v, dt.datetime) else str(v) if isinstance(v, Decimal) else v
    return json.dumps(out)


def _change(names, log, position, table, before, after):
    op = "I" if before is None else "D" if after is None else "U"
    return (log, position, table, op, *(None if x is None else _text(x, names[table]) for x in (before, after)))


def _feed(spark, changes):
    return spark.createDataFrame(changes, live.FEED_SCHEMA)


def _set(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _batch(f):
    items = pricing.inventory_item(f["products"], f["sales"], f["promotions"], f["inventory"])
    view = cartops.dynamic_cart(f["shopping_cart"], f["products"], f["categories"], items, f["inventory"])
    return items, view, hierarchy.category_totals(f["categories"], view)


def _same(reader, frames):
    items, view, totals = _batch(frames)
    assert _set(reader.inventory_item()) == _set(items)
    assert _set(reader.dynamic_cart()) == _set(view)
    assert _set(reader.category_totals()) == _set(totals)
    assert _set(reader.recent_prices()) == _set(pricing.recent_prices(frames["sales"]))


def _random_changes(rng, rows, names, n):
    """Changes of all tables in the order of one log; ``rows`` ends as what they lead to."""
    fresh = {
        "products": lambda i: (rng.randrange(1, 22), f"p{i}", Decimal(f"{rng.randrange(1, 30)}.00"), rng.choice([100, 101, 102, 104]), 1, True, T0),
        "sales": lambda i: (1000 + i, rng.randrange(1, 22), Decimal(f"{rng.randrange(1, 20)}.0000"), T0 + dt.timedelta(days=rng.randrange(40)),
                            Decimal(f"{rng.randrange(1, 20)}.00")),
        "promotions": lambda i: (100 + i, rng.randrange(1, 20), Decimal(f"{rng.randrange(60)}.00"), T0, T0, rng.random() < 0.7, T0),
        "inventory": lambda i: (100 + i, rng.randrange(1, 22), rng.randrange(90), 1, T0),
        "shopping_cart": lambda i: (rng.randrange(1, 20), f"p{rng.randrange(3)}", 100, Decimal("1.00"), T0),
        "categories": lambda i: (rng.randrange(100, 106), f"c{i}", rng.choice([1, 2, None])),
    }
    out = []
    for i in range(n):
        table = rng.choice(sorted(fresh))
        keyed, held = table in ("products", "categories"), rows[table]
        if rng.random() < 0.3 and held:
            old = held.pop(rng.randrange(len(held)))
            out.append(_change(names, "log", i + 1, table, old, None))
            continue
        new, old = fresh[table](i), None
        if keyed:
            old = next((r for r in held if r[0] == new[0]), None)
            if old is not None:
                held.remove(old)
        elif rng.random() < 0.5 and held:
            old = held.pop(rng.randrange(len(held)))
        held.append(new)
        out.append(_change(names, "log", i + 1, table, old, new))
    return out


@pytest.mark.parametrize("seed,buckets", [(1, 3), (2, None)])
def test_random_changes_equal_batch(spark, scratch, seed, buckets):
    rng, rows = random.Random(seed), _rows()
    start = _frames(spark, rows)
    names = {n: f.columns for n, f in start.items()}
    changes = _random_changes(rng, rows, names, 90)
    sent = changes + rng.sample(changes, 20)
    rng.shuffle(sent)
    for lo in range(0, len(sent), 40):
        _feed(spark, sent[lo:lo + 40]).coalesce(1).write.mode("append").parquet(f"{scratch}/feed")
    views = live.LiveViews(spark, f"{scratch}/kept", buckets=buckets)
    views.load(start)
    first = views.reader(0)
    before = first.inventory_item()
    _same(first, start)
    views.start(f"{scratch}/feed", max_files_per_trigger=1).awaitTermination()
    assert views.version() == 3
    end = _frames(spark, rows)
    _same(views.reader(), end)
    # a reader of the first version still reads it, and the logs lead from there to here
    was, now = ({r[0]: r[1] for r in x.collect()} for x in (before, _batch(end)[0]))
    deltas = {r.product_id: (r.old_price, r.new_price) for r in views.price_deltas(0, 3).collect()}
    assert deltas == {p: (was.get(p), now.get(p)) for p in was.keys() | now.keys() if was.get(p) != now.get(p)}
    # one interval, however many changes and however they came
    assert [tuple(r) for r in views.seen(3).collect()] == [("log", 1, 90)]


def test_values_return_and_deliveries_repeat(spark, scratch):
    rows = _rows()
    start = _frames(spark, rows)
    names = {n: f.columns for n, f in start.items()}
    views = live.LiveViews(spark, scratch, buckets=2)
    views.load(start)
    five, six = (1, 1, 5, 1, T0), (1, 1, 6, 1, T0)
    line = (3, "p3", 100, Decimal("1.00"), T0)
    steps = [_change(names, "w", 1, "inventory", five, six), _change(names, "w", 2, "inventory", six, five),
             _change(names, "w", 3, "inventory", five, six), _change(names, "w", 4, "shopping_cart", None, line),
             _change(names, "w", 5, "shopping_cart", None, line)]
    for b, step in enumerate(steps):
        views.fold(_feed(spark, [step, *steps[:b]]), b)                     # each batch delivers the earlier ones again
    views.fold(_feed(spark, steps[:b]), b)                                  # the last batch runs again, with other rows
    views.fold(_feed(spark, [steps[b]]), b)
    now = views.reader(len(steps))
    assert {r.product_id: r.total_stock for r in now.stock().collect()}[1] == 6
    assert {r.product_id: r.n for r in now.cart_lines().collect()}[3] == 2


def test_snapshot_in_the_middle_of_a_log(spark, scratch):
    rng, rows = random.Random(5), _rows()
    names = {n: f.columns for n, f in _frames(spark, rows).items()}
    changes = _random_changes(rng, rows, names, 30)
    snapshot = {n: list(r) for n, r in rows.items()}
    changes += [(log, position + 30, *rest) for log, position, *rest in _random_changes(rng, rows, names, 30)]
    views = live.LiveViews(spark, scratch, buckets=1)
    views.load(_frames(spark, snapshot), {("log", n): 30 for n in snapshot})
    views.fold(_feed(spark, changes[10:40]), 0)
    views.fold(_feed(spark, changes), 1)
    _same(views.reader(2), _frames(spark, rows))


def test_untouched_products_are_not_written(spark, scratch):
    """A change that moves no edge stores one price and reads only its bucket."""
    start = _frames(spark, _rows())
    names = {n: f.columns for n, f in start.items()}
    views = live.LiveViews(spark, scratch, buckets=16)
    views.load(start)
    views.fold(_feed(spark, [_change(names, "a", 1, "promotions", None, (9, 4, Decimal("30.00"), T0, T0, True, T0))]), 0)
    assert views.tables["prices"].read(1).where("seq = 1").count() == 1
    assert {(b, v) for b, v, kind in views.tables["prices"]._parts() if kind == "more"} == {
        (r[0], 1) for r in start["products"].where("product_id = 4").select(views.tables["prices"].bucket()).collect()}
    assert not [v for _, v, kind in views.tables["sales"]._parts() if kind == "more"]


def test_a_reader_stays_whole_over_many_batches(spark, scratch, monkeypatch):
    monkeypatch.setattr(live.LoggedTable, "PARTS", 2)
    rows = _rows()
    start = _frames(spark, rows)
    names = {n: f.columns for n, f in start.items()}
    views = live.LiveViews(spark, scratch, buckets=1)
    views.load(start)
    held, stock = views.reader(0), (1, 1, 5, 1, T0)
    for b in range(4):
        new = (1, 1, 6 + b, 1, T0)
        views.fold(_feed(spark, [_change(names, "w", b, "inventory", stock, new)]), b)
        stock = new
    _same(held, start)
    reconciled = cartops.reconcile_cart(held.dynamic_cart(), held.category_totals()).first()
    assert reconciled["delta"] == 0
    held.close()
    views.fold(_feed(spark, [_change(names, "w", 4, "inventory", stock, (1, 1, 50, 1, T0))]), 4)
    assert 0 not in {v for _, v, kind in views.tables["inventory"]._parts() if kind == "full"}
    assert {r.product_id: r.total_stock for r in views.reader(5).stock().collect()}[1] == 50


def test_seen_intervals(spark):
    seen = spark.createDataFrame([("a", 1, 10), ("b", 5, 5)], "log string, lo bigint, hi bigint")
    batch = _feed(spark, [("a", p, "t", "I", None, None) for p in (11, 12, 14, 3, 70_000, 70_001, 65_535, 65_536)]
                  + [("c", 1, "t", "I", None, None), ("b", 4, "t", "I", None, None)])
    assert _set(live.with_seen(seen, batch)) == sorted(
        [("a", 1, 12), ("a", 14, 14), ("a", 65_535, 65_536), ("a", 70_000, 70_001), ("b", 4, 5), ("c", 1, 1)], key=repr)
    cuts = spark.createDataFrame([("c", "t", 1)], "log string, `table` string, position bigint")
    got = live.not_seen(batch.unionByName(batch), seen, cuts).select("log", "position")
    assert _set(got) == _set(batch.select("log", "position").where("NOT (log = 'a' AND position = 3) AND log <> 'c'"))
