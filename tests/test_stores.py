"""The commit log and the views that are kept up in it, on small hand-made events."""

import pytest
from pyspark.sql import functions as F

from poolscope.functions import pricing
from poolscope.functions.numeric import NANOS
from poolscope.operators import actions, checks, ledger
from poolscope.operators.buckets import BadRequest
from poolscope.operators.distinct import DistinctStore
from poolscope.operators.rollup import Aggregate
from poolscope.schemas import table_schema
from poolscope.sources import commits
from poolscope.sources.commits import CommitLog
from poolscope.streaming import action_store
from poolscope.streaming.action_store import ACTIONS, EXTRAS, POSTINGS, ActionStore
from poolscope.streaming.member_store import MEMBERS, MemberStore
from poolscope.streaming.rollup_store import RollupStore

DAY = 86_400 * NANOS


def table(spark, name, rows):
    """Rows of an event table, given as dicts; what isn't given is null."""
    schema = table_schema(name)
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)


def batch(spark, switches=(), stakes=(), pending=(), unstakes=(), outs=(), fees=()):
    names = {
        "switch_events": switches, "stake_events": stakes, "pending_liquidity_events": pending, "unstake_events": unstakes,
        "outbound_events": outs, "fee_events": fees,
    }
    return {name: table(spark, name, rows) for name, rows in names.items()}


def switch(day, n, to="to"):
    return {"tx": f"TX{day}-{n}", "from_addr": f"from{n}", "to_addr": to, "burn_asset": "A.B", "burn_e8": 5, "mint_e8": 5, "event_idx": n, "block_timestamp": day * DAY + n}


def out(ref, day, n):
    return {"tx": f"OUT{n}", "from_addr": "vault", "to_addr": f"paid{n}", "asset": "A.B", "asset_e8": n, "in_tx": ref, "event_idx": n, "block_timestamp": day * DAY + n}


def fee(ref, day, n):
    return {"tx": ref, "asset": "A.B", "asset_e8": n, "pool_deduct": 0, "event_idx": n, "block_timestamp": day * DAY + n}


def add(day, n, kind="add"):
    own = {"pool": "A.B", "asset_tx": f"a{n}", "asset_addr": f"asset{n}", "asset_e8": 3, "rune_tx": f"r{n}", "rune_addr": f"rune{n}", "rune_e8": 4}
    return own | {"pending_type": kind, "stake_units": 7, "event_idx": n, "block_timestamp": day * DAY + n}


BATCHES = [
    {"switches": [switch(d, n) for d in (1, 2, 3) for n in range(4)], "pending": [add(2, 50), add(3, 51)], "outs": [out("TX9-0", 1, 1), out("TX1-1", 2, 2)]},
    {"switches": [switch(d, n, "other") for d in (5, 6) for n in range(3)], "stakes": [add(5, 50)], "outs": [out("TX1-1", 1, 9), out("TX3-0", 5, 3)], "fees": [fee("TX1-1", 5, 4)]},
    {"switches": [switch(9, 0)], "pending": [add(9, 51, "withdraw")], "outs": [out("TX6-2", 9, 5)], "fees": [fee("TX6-2", 9, 6), fee("TX2-0", 9, 7)]},
]


def together(spark, upto=3, before=None):
    tables = [batch(spark, **b) for b in BATCHES[:upto]]
    whole = {name: tables[0][name] for name in tables[0]}
    for more in tables[1:]:
        whole = {name: rows.unionByName(more[name]) for name, rows in whole.items()}
    return whole if before is None else {name: rows.filter(F.col("block_timestamp") < before) for name, rows in whole.items()}


def told(rows):
    return sorted(str(r.asDict(True)) for r in rows.select(*actions.COLUMNS).collect())


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Actions, members and events of three batches, the second of which came twice."""
    log = CommitLog(spark, f"file://{tmp_path_factory.mktemp('stored')}")
    store = ActionStore(log)
    came = []
    for epoch in (0, 1, 1, 2):
        tables = batch(spark, **BATCHES[epoch])
        came.append(store.apply(tables, str(epoch), tables))
    assert came == [True, True, False, True] and log.version == 3
    return store


def test_actions_by_batch_equal_actions_at_once(spark, stored):
    want = told(actions.build_actions(together(spark)))
    assert told(stored.log.read(ACTIONS)) == want
    # a fresh reader sees the same
    assert told(CommitLog(spark, stored.log.path).read(ACTIONS)) == want


def test_selections_open_listed_files_only(spark, stored):
    whole = actions.build_actions(together(spark))
    for wanted, files in (({"address": "paid9"}, 1), ({"address": "from3,paid3"}, 3), ({"txid": "out5"}, 1), ({"asset": "THOR.RUNE"}, None), ({"types": ["addLiquidity"]}, None), ({"txid": "none"}, 0), ({"address": "from1", "types": ["switch"], "asset_type": "native"}, 5)):
        got = stored.select(**wanted)
        assert told(got) == told(actions.select_actions(whole, **wanted))
        if files is not None:
            assert len(got.inputFiles()) == files < len(stored.log.read(ACTIONS).inputFiles())
    with pytest.raises(BadRequest):
        stored.select(asset_type="both")


@pytest.mark.parametrize("wanted", [{}, {"address": "other"}, {"address": "from0,from1"}, {"types": ["switch"], "asset": "A.B"}, {"address": "nobody"}])
@pytest.mark.parametrize("limit, offset", [(50, 0), (2, 3), (1, 17), (5, 100)])
def test_pages_equal_those_of_all_actions(spark, stored, wanted, limit, offset):
    whole = actions.select_actions(actions.build_actions(together(spark)), **wanted)
    whole = spark.createDataFrame(whole.collect(), whole.schema)
    got = stored.page(limit, offset, **wanted).collect()
    want = actions.page(actions.with_status(whole), limit, offset).collect()
    assert [(r["block_timestamp"], r["main_ref"], r["type"], r["status"]) for r in got] == [(r["block_timestamp"], r["main_ref"], r["type"], r["status"]) for r in want]
    assert {r["total"] for r in got} <= {whole.count()}


def test_batches_of_many_references(spark, tmp_path, monkeypatch):
    """References are joined, a transaction is posted once, and batches take only the disk that they need."""
    monkeypatch.setattr(action_store, "LOOKED_UP", 0)
    store, cleaned = ActionStore(CommitLog(spark, f"file://{tmp_path}")), []
    write = store.log._stage
    monkeypatch.setattr(store.log, "_stage", lambda *rest: (cleaned.append(spark.conf.get(commits.CLEANUP)), write(*rest))[1])
    kept = spark.conf.get(commits.CLEANUP)
    for b in BATCHES:
        store.apply(batch(spark, **b))
    assert set(cleaned) == {"true"} and spark.conf.get(commits.CLEANUP) == kept == "false"
    assert told(store.log.read(ACTIONS)) == told(actions.build_actions(together(spark)))
    postings = store.log.read_parts(POSTINGS, store.log.parts(POSTINGS))
    assert {r["value"][:3] for r in postings.filter("kind = 'ref'").collect()} == {"PL:"}
    assert max(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 100_000


def test_a_page_opens_the_newest_days_only(stored):
    assert {p.split("/key=")[1].split("/")[0] for p in stored.page(2, 0).inputFiles()} <= {"9", "6"}
    assert {p.split("/key=")[1].split("/")[0] for p in stored.page(2, 4).inputFiles()} == {"5"}
    with pytest.raises(BadRequest):
        stored.page(51)


def test_compaction_keeps_answers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "MOST_PARTS", 1)
    monkeypatch.setattr(commits, "BASE_EVERY", 2)
    store = ActionStore(CommitLog(spark, f"file://{tmp_path}"))
    for b in BATCHES:
        store.apply(batch(spark, **b))
    before = len(store.log.parts(POSTINGS)), len(store.log.parts(EXTRAS))
    store.compact()
    assert (len(store.log.parts(POSTINGS)), len(store.log.parts(EXTRAS))) < before
    again = ActionStore(CommitLog(spark, store.log.path))
    assert again.log.live == store.log.live
    assert told(again.select(address="paid9")) == told(actions.select_actions(actions.build_actions(together(spark)), address="paid9"))


@pytest.mark.parametrize("cut", [0, 2 * DAY + 2, 5 * DAY + 2, 9 * DAY, 20 * DAY])
def test_a_trim_undoes_what_came_later(spark, tmp_path, cut):
    """Late outbounds leave their actions, settled pending adds come back, and ingesting again gives the same tables."""
    log = CommitLog(spark, f"file://{tmp_path}")
    store, members = ActionStore(log), MemberStore(log, 4)
    for epoch, b in enumerate(BATCHES):
        tables = batch(spark, **b)
        more, less = members.staged(tables)
        store.apply(tables, str(epoch), tables)
        log.commit(more, less)
    log.trim(cut, [store, members])
    early = together(spark, before=cut)
    assert told(log.read(ACTIONS)) == told(actions.build_actions(early))
    changes = lambda t: ledger.member_changes(*(t[n] for n in ("stake_events", "unstake_events", "pending_liquidity_events")))
    assert sorted(map(str, members.read().collect())) == sorted(map(str, ledger.members(changes(early)).collect()))
    for name, rows in early.items():
        assert log.read(name).count() == rows.count()
    later = {name: rows.filter(F.col("block_timestamp") >= cut) for name, rows in together(spark).items()}
    assert store.apply(later, "0", later)  # epochs come again
    assert told(log.read(ACTIONS)) == told(actions.build_actions(together(spark)))


def test_a_flush_is_seen_whole_or_not_at_all(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}")
    one, two = table(spark, "switch_events", [switch(1, 0), switch(40, 1)]), table(spark, "fee_events", [fee("a", 1, 1)])
    log.flush({"switch_events": one, "fee_events": two}, "first")
    broken = two.withColumn("tx", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        log.flush({"switch_events": one, "fee_events": broken}, "second")
    for reader in (log, CommitLog(spark, log.path)):
        assert (reader.read("switch_events").count(), reader.read("fee_events").count(), reader.version) == (2, 1, 1)
    assert log.flush({"switch_events": one, "fee_events": two}, "second") and not log.flush({"switch_events": one}, "second")
    assert CommitLog(spark, log.path).read("switch_events", DAY, 2 * DAY).count() == 2
    assert len(log.read("switch_events", 30 * DAY).inputFiles()) == 2
    # a writer that has not seen the newest commit fails
    old = CommitLog(spark, log.path)
    log.flush({"fee_events": two})
    with pytest.raises(Exception, match="(?i)already exists"):
        old.flush({"fee_events": two})
    with pytest.raises(KeyError):
        log.read("pool_events")


def test_an_empty_log(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/none")
    store = ActionStore(log)
    assert store.apply(batch(spark)) and store.page().count() == 0 and store.select(address="a").count() == 0
    assert log.read(ACTIONS).count() == 0 and log.parts(ACTIONS) == []


def test_members_by_batch_read_touched_buckets_only(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}")
    store = MemberStore(log, 8)
    unstake = lambda day, n, units: {"tx": "t", "from_addr": f"rune{n}", "pool": "A.B", "stake_units": units, "emit_asset_e8": 1, "emit_rune_e8": 2, "event_idx": 90 + n, "block_timestamp": day * DAY + n}
    lives = [
        {"stakes": [add(1, n) for n in range(20)], "pending": [add(1, 30), add(1, 3)]},
        {"unstakes": [unstake(2, 3, 7)], "pending": [add(2, 30)], "stakes": [add(2, 5)]},
        {"unstakes": [unstake(3, 5, 14)], "stakes": [add(4, 3), add(4, 30)], "pending": [add(4, 5), add(5, 5, "withdraw")]},
    ]
    fold = lambda some: ledger.members(ledger.member_changes(*(_union(spark, some)[n] for n in ("stake_events", "unstake_events", "pending_liquidity_events"))))
    for k, b in enumerate(lives):
        before = {p.path for p in log.parts(MEMBERS)}
        store.apply(batch(spark, **b), str(k))
        assert sorted(map(str, store.read().collect())) == sorted(map(str, fold(lives[: k + 1]).collect()))
        if k:
            assert before & {p.path for p in log.parts(MEMBERS)}  # parts of other buckets stay as they are


def _union(spark, some):
    tables = [batch(spark, **b) for b in some]
    whole = tables[0]
    for more in tables[1:]:
        whole = {name: rows.unionByName(more[name]) for name, rows in whole.items()}
    return whole


def test_a_late_row_makes_one_slice_anew(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}")
    agg = Aggregate("burnt", ["burn_asset"]).sum("n", F.lit(1)).sum("burn_e8").last("last", F.col("tx"))
    store = RollupStore(log, agg, "switch_events")
    rows = [switch(d, n) | {"block_timestamp": d * DAY + n * 1800 * NANOS} for d in range(1, 6) for n in range(30)]
    store.append(table(spark, "switch_events", rows), "0")
    assert store.refresh() == [1, 2, 3, 4, 5] and store.refresh() == []
    before = {i: {p.path for p in log.parts(store._name(i))} for i in ("5min", "hour", "day")}
    late = [switch(3, 77) | {"block_timestamp": 3 * DAY + 5 * NANOS}]
    assert store.append(table(spark, "switch_events", late), "1") and not store.append(table(spark, "switch_events", late), "1")
    shown = lambda rows: sorted(map(str, agg.final(rows).collect()))
    check = lambda: [shown(store.read(i)) == shown(agg.rollup(log.read("switch_events"), i)) for i in ("5min", "hour", "day")]
    assert all(check())  # while stale
    assert store.refresh() == [3] and all(check())
    for i, paths in before.items():
        now = {p.path for p in log.parts(store._name(i))}
        assert len(paths - now) == len(now - paths) == 1
    log.trim(3 * DAY + 7000 * NANOS, [store])
    assert all(check()) and log.read("switch_events").agg(F.max("block_timestamp")).first()[0] == 3 * DAY + 5400 * NANOS


def test_distinct_counts_equal_raw_counts(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}", 2)
    store = DistinctStore(log, "senders", F.col("from_addr"))
    rows = [switch(d, n) | {"from_addr": f"from{(n * d) % 11}" if n else None} for d in range(1, 9) for n in range(12)]
    whole = table(spark, "switch_events", rows)
    assert store.count(whole, 0, 99 * DAY).first()["n"] == 11  # nothing stored yet
    for epoch, part in enumerate((whole.filter("event_idx % 2 = 0"), whole.limit(0), whole.filter("event_idx % 2 = 1"), whole.filter("event_idx = 3"))):
        assert store.append(part, str(epoch)) and not store.append(part, str(epoch))
    numbers = log.read_parts(store.numbers, log.parts(store.numbers)).collect()
    assert len(numbers) == len({r["number"] for r in numbers}) == len({r["value"] for r in numbers}) == 11
    for low, high in ((0, 99 * DAY), (2 * DAY, 3 * DAY), (2 * DAY + 4, 5 * DAY + 3), (3 * DAY + 2, 3 * DAY + 9), (50 * DAY, 60 * DAY), (DAY + 3, 2 * DAY)):
        want = len({r["from_addr"] for r in rows if low <= r["block_timestamp"] < high and r["from_addr"]})
        assert store.count(whole, low, high).first()["n"] == want
    # whole days come from their bitmaps alone
    assert store.count(whole.limit(0), 2 * DAY, 4 * DAY).first()["n"] == 11


def test_a_divergence_reads_slices_below_it_only(spark, tmp_path):
    rows = [(h, f"p{k}", h * 31 % 17) for h in range(4000) for k in range(2)]
    ours = spark.createDataFrame(rows, "height long, pool string, v long")
    for name, changed in {"one": {(2777, "p1")}, "two": {(5, "p0"), (3999, "p0"), (64, "p1")}, "none": set()}.items():
        theirs = ours.withColumn("v", F.when(F.concat_ws(":", "height", "pool").isin([f"{h}:{p}" for h, p in changed]), -1).otherwise(F.col("v")))
        theirs = theirs.filter("not (height = 3900 and pool = 'p1')") if name == "two" else theirs
        both = []
        for side, history in (("ours", ours), ("theirs", theirs)):
            path = f"file://{tmp_path}/{name}-{side}"
            history.withColumn("slice", F.call_function("div", F.col("height"), F.lit(16))).repartition("slice").write.partitionBy("slice").parquet(path)
            tree = f"{path}-tree"
            checks.write_tree(checks.digest_tree(spark.read.parquet(path), ["pool"], ["v"], 16), tree)
            both.append((spark.read.parquet(path), spark.read.parquet(tree)))
        (a, tree_a), (b, tree_b) = both
        got = checks.first_divergence_by_tree(a, b, tree_a, tree_b, ["pool"], ["v"], 16)
        want = {}
        for h, p in changed:
            want[p] = min(h, want.get(p, h))
        assert {r["pool"]: r["first_height"] for r in got.collect()} == want
        if name == "one":  # of the histories 16 heights are asked, of each level of the trees 16 nodes
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "GreaterThanOrEqual(height,2768), LessThan(height,2784)" in plan


@pytest.mark.parametrize("n", [1, 2, 3, 500])
def test_ranks_by_bins(spark, n):
    rows = [(s, (k * 7919 + len(s)) % 1000 * 10**12 - 5 * 10**14 + (k % 3)) for s in ("Active", "Standby", "x") for k in range(n)] + [("same", 5)] * n
    got = pricing.kth_values(spark.createDataFrame(rows, "status string, bond long"), "status", "bond", F.floor(F.col("n") / 2))
    want = {s: sorted(b for t, b in rows if t == s)[n // 2] for s, _ in rows}
    assert {r["status"]: r["kth"] for r in got.collect()} == want
