"""Registered queries: every operator over whole tables. ``oracle.py`` holds the SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesync.functions.columns import (
    binary_to_hex as columns_to_hex,
    mark_generated,
    project_aligned as aligned,
    project_full_sync as full_projection,
    strip_metadata as without_metadata,
)
from tablesync.functions.hashing import combined_hash as hash_of_rows
from tablesync.functions.hashing import row_hash as hash_per_row
from tablesync.model import DEFAULT_FEED, Mapping
from tablesync.operators import changes as ch
from tablesync.operators import control as ct
from tablesync.operators import keyed as kd
from tablesync.operators import ledger as lg
from tablesync.operators import reconcile as rc
from tablesync.operators import registry as rg
from tablesync.operators.ledger import LedgerRules
from tablesync.operators import verify as vf
from tablesync.plans.jobs import Endpoints, Options, SyncEngine
from tablesync.sinks.control_store import ControlStore
from tablesync.sinks.files import cluster_by_key as clustered, stage, stage_keys, tsv_encode as encode, write_tsv
from tablesync.sinks.snapshot import SnapshotTarget
from tablesync.sources.folders import fresh_folder
from tablesync.streaming.stream import stream_sync as start_stream
from tablesync.streaming.summary import SummaryStore, summary_stream
from tablesync.workload import fixtures as fx
from tablesync.workload.fixtures import KEY, SHORT

# Decimals of floating-point numbers in hash text: fixed so that other engines give the same text.
SCALE = 6
TARGET_BUCKETS = 8

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def _later(r: fx.Replication) -> DataFrame:
    return ch.lsn_window(r.chg, r.from_lsn, names=SHORT)


def _target(spark: SparkSession, key=KEY, **options) -> SnapshotTarget:
    return SnapshotTarget(spark, fresh_folder(spark, "target"), key, TARGET_BUCKETS, **options)


#: Rules that another engine can follow: MD5 of the canonical text, buckets by remainder.
LEDGER = LedgerRules(checksum="md5", float_scale=SCALE, bucket_of=f"{KEY} % 16")


# ---- scans and key sets ------------------------------------------------------------------------------------------


@query
def scan_full(spark, sf):
    return fx.replication(spark, sf).orders


@query
def scan_by_keys(spark, sf):
    r = fx.replication(spark, sf)
    return kd.read_by_keys(r.src, kd.changed_keys(_later(r), KEY), KEY)


@query
def changes_since(spark, sf):
    r = fx.replication(spark, sf)
    return ch.read_changes(r.chg, r.from_lsn, names=SHORT, ordered=True)


@query
def changes_since_upper_hex(spark, sf):
    """A feed that spells positions in upper case: the position keeps the spelling of the feed."""
    r = fx.replication(spark, sf)
    feed = r.chg.withColumn("start_lsn", F.upper("start_lsn"))
    return ch.read_changes(feed, F.upper(r.from_lsn), names=SHORT)


@query
def changes_since_binary(spark, sf):
    """A feed with binary positions, shown as hex text."""
    r = fx.replication(spark, sf)
    feed = r.chg.withColumns({"start_lsn": F.unhex("start_lsn"), "seqval": F.unhex("seqval")})
    return columns_to_hex(ch.read_changes(feed, r.from_lsn, names=SHORT))


@query
def verify_full_types(spark, sf):
    """Equal values in other types (wider decimals, longer integers) are no differences; changed ones are."""
    r = fx.replication(spark, sf)
    exact = lambda df, scale: df.select(KEY, F.col("o_totalprice").cast(f"decimal(18,{scale})").alias("o_totalprice"))
    src = exact(r.src, 2).withColumn(KEY, F.col(KEY).cast("decimal(20,0)"))
    return vf.verify_full(src, exact(r.dst, 4), KEY)


@query
def verify_full_scaled(spark, sf):
    """Prices that differ only behind the fixed decimals are equal."""
    r = fx.replication(spark, sf)
    src = r.src.select(KEY, (F.col("o_totalprice").cast("double") + 1e-9).alias("o_totalprice"))
    return vf.verify_full(src, r.dst.select(KEY, F.col("o_totalprice").cast("double").alias("o_totalprice")), KEY, float_scale=2)


@query
def full_sync_identity(spark, sf):
    """Full sync over a target with an identity column: the copy gets the values of the source."""
    r, target = fx.replication(spark, sf), _target(spark)
    target.overwrite(mark_generated(r.dst, "o_custkey", "identity"))
    _checked([_engine(spark, r, target, lambda: r.orders).full_sync(ORDERS)])
    return target.read()


@query
def tail_by_key(spark, sf):
    return vf.tail_by_key(fx.replication(spark, sf).dst, KEY, 10)


@query
def changed_keys(spark, sf):
    return kd.changed_keys(_later(fx.replication(spark, sf)), KEY)


@query
def lsn_bounds(spark, sf):
    return ch.lsn_bounds(fx.replication(spark, sf).chg, SHORT)


@query
def change_summary(spark, sf):
    return ch.change_summary(_later(fx.replication(spark, sf)), KEY, SHORT)


@query
def apply_counts(spark, sf):
    r = fx.replication(spark, sf)
    return ch.apply_counts(r.dst, r.src, kd.changed_keys(_later(r), KEY), KEY)


@query
def bootstrap_window(spark, sf):
    return ch.bootstrap_window(fx.replication(spark, sf).chg, None, "parity", SHORT)


# ---- apply -------------------------------------------------------------------------------------------------------


@query
def delete_by_keys(spark, sf):
    r = fx.replication(spark, sf)
    return kd.delete_by_keys(r.dst, kd.changed_keys(_later(r), KEY), KEY)


@query
def replace_by_keys(spark, sf):
    r = fx.replication(spark, sf)
    return kd.replace_by_keys(r.dst, r.src, kd.changed_keys(r.chg, KEY), KEY)


@query
def replace_by_keys_window(spark, sf):
    r = fx.replication(spark, sf)
    return kd.replace_by_keys(r.dst, r.src, kd.changed_keys(_later(r), KEY), KEY)


@query
def replace_by_keys_composite(spark, sf):
    talk = fx.table(spark, sf, "conversations")
    key = ["conv_id", "turn"]
    part = (F.col("conv_id") + F.col("turn")) % 5
    src = talk.where(part != 0)
    dst = talk.withColumn("text", F.when(part == 1, F.upper("text")).otherwise(F.col("text")))
    return kd.replace_by_keys(dst, src, talk.where(part < 2).select(*key), key)


@query
def replace_by_keys_lineitem(spark, sf):
    """The lines of changed orders; the key is not unique in the table."""
    lines = fx.table(spark, sf, "lineitem")
    part = F.col("l_orderkey") % 10
    dst = lines.withColumn("l_quantity", F.when(part == 5, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    keys = kd.changed_keys(lines.where(part.isin(5, 7)), "l_orderkey")
    return kd.replace_by_keys(dst, lines.where(part != 7), keys, "l_orderkey")


@query
def apply_ops(spark, sf):
    r = fx.replication(spark, sf)
    return kd.apply_ops(r.dst, r.chg, KEY, SHORT)


# ---- projections and text ----------------------------------------------------------------------------------------


@query
def project_full_sync(spark, sf):
    r = fx.replication(spark, sf)
    src = r.orders.select("o_orderpriority", "o_custkey", "o_totalprice", KEY, "o_orderdate", "o_orderstatus")
    return full_projection(src, mark_generated(r.dst, "o_custkey", "identity"), KEY)


@query
def project_aligned(spark, sf):
    r = fx.replication(spark, sf)
    src = r.orders.select(
        F.col("o_orderdate").alias("O_ORDERDATE"), F.col(KEY).alias("O_OrderKey"), "o_custkey", "o_totalprice"
    )
    dst = r.dst.select("o_totalprice", KEY, "o_orderpriority", "o_orderdate")
    return aligned(src, dst, KEY)


@query
def strip_metadata(spark, sf):
    chg = fx.replication(spark, sf).chg
    names = dict(zip(SHORT, DEFAULT_FEED, strict=True))
    return without_metadata(chg.withColumnsRenamed(names))


@query
def binary_to_hex(spark, sf):
    chg = fx.replication(spark, sf).chg
    return columns_to_hex(chg.withColumns({c: F.unhex(c) for c in ("start_lsn", "seqval")}))


@query
def tsv_encode(spark, sf):
    return encode(fx.table(spark, sf, "events"))


@query
def tsv_encode_documents(spark, sf):
    return encode(fx.table(spark, sf, "documents"))


# ---- hashes and verification -------------------------------------------------------------------------------------


@query
def row_hash(spark, sf):
    return hash_per_row(fx.replication(spark, sf).orders, KEY, float_scale=SCALE)


@query
def row_hash_documents(spark, sf):
    return hash_per_row(fx.table(spark, sf, "documents"), "doc_id")


@query
def combined_hash(spark, sf):
    return hash_of_rows(vf.tail_by_key(fx.replication(spark, sf).src, KEY, 10), KEY, float_scale=SCALE)


@query
def verify_tail(spark, sf):
    r = fx.replication(spark, sf)
    return vf.verify_tail(r.src, r.dst, KEY, 10, SCALE)[0]


@query
def verify_tail_rows(spark, sf):
    r = fx.replication(spark, sf)
    return vf.verify_tail_rows(r.src, r.dst, KEY, 50, SCALE).select(KEY, "status")


@query
def mismatch_sample(spark, sf):
    r = fx.replication(spark, sf)
    return vf.verify_tail(r.src, r.dst, KEY, 500, SCALE)[1]


@query
def verify_buckets(spark, sf):
    """Row counts and the first three words of the checksums."""
    found = verify_buckets_all_bits(spark, sf)
    return found.drop(*[f"{side}_sum{w}" for side in ("src", "dst") for w in range(3, 7)])


@query
def verify_buckets_all_bits(spark, sf):
    r = fx.replication(spark, sf)
    bucket = (F.col(KEY) % 16).cast("int")
    return vf.verify_buckets(r.src, r.dst, KEY, float_scale=SCALE, bucket_of=bucket, checksum="md5")


@query
def verify_full(spark, sf):
    r = fx.replication(spark, sf)
    return vf.verify_full(r.src, r.dst, KEY)


@query
def verify_full_lineitem(spark, sf):
    """Rows that share a key are compared as a multiset."""
    lines = fx.table(spark, sf, "lineitem")
    part = F.col("l_orderkey") % 10
    changed = F.when((part == 5) & (F.col("l_linenumber") == 1), F.col("l_tax") + 1).otherwise(F.col("l_tax"))
    dst = lines.where((part != 3) | (F.col("l_linenumber") != 2)).withColumn("l_tax", changed)
    return vf.verify_full(lines.where(part != 7), dst, "l_orderkey")


@query
def verify_full_documents(spark, sf):
    docs = fx.table(spark, sf, "documents")
    part = F.col("doc_id") % 10
    changed = F.when(part == 5, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    return vf.verify_full(docs.where(part != 7), docs.where(part != 3).withColumn("text", changed), "doc_id")


@query
def verify_sets_lineitem(spark, sf):
    """Scattered differences by set reconciliation; the key is not unique."""
    lines = fx.table(spark, sf, "lineitem")
    part = F.col("l_orderkey") % 100
    changed = F.when((part == 5) & (F.col("l_linenumber") == 1), F.col("l_tax") + 1).otherwise(F.col("l_tax"))
    dst = lines.where((part != 3) | (F.col("l_linenumber") != 2)).withColumn("l_tax", changed)
    return rc.verify_sets(lines.where(part != 7), dst, "l_orderkey")


@query
def verify_sets_documents(spark, sf):
    """A few differing documents by set reconciliation."""
    docs = fx.table(spark, sf, "documents")
    part = F.col("doc_id") % 100
    changed = F.when(part == 5, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    return rc.verify_sets(docs.where(part != 7), docs.where(part != 3).withColumn("text", changed), "doc_id")


@query
def ledger_after_changes(spark, sf):
    """The ledger of the copy after change sync from the middle of the feed, kept up by the passes alone."""
    engine, target = cdc_from_middle(spark, sf, _target(spark, ledger=LEDGER))
    _checked([engine.cdc_sync(ORDERS)])
    return target.ledger()[0]


@query
def verify_ledger(spark, sf):
    """The source against the ledger of the copy, which is half a feed behind."""
    r = fx.replication(spark, sf)
    engine, target = cdc_from_middle(spark, sf, _target(spark, ledger=LedgerRules()))
    _checked([engine.cdc_sync(ORDERS)])
    return lg.verify_ledger(r.src, target.read(), target.ledger()[0], KEY, LedgerRules())


@query
def validate_schema(spark, sf):
    return ct.validate_mappings(fx.mappings(spark, sf), *fx.column_catalogues(spark, sf))


@query
def reconcile_counts(spark, sf):
    orders = fx.replication(spark, sf).orders
    target = _target(spark)
    target.overwrite(orders)
    return vf.reconcile_counts(orders, target.read())


@query
def reconcile_counts_mismatch(spark, sf):
    """The stale copy holds another number of rows than the source."""
    r = fx.replication(spark, sf)
    return vf.reconcile_counts(r.orders, r.dst)


# ---- targets, jobs and streams -----------------------------------------------------------------------------------


@query
def staged_roundtrip(spark, sf):
    r = fx.replication(spark, sf)
    return stage(kd.read_by_keys(r.src, kd.changed_keys(_later(r), KEY), KEY), fresh_folder(spark, "extract"))


@query
def append(spark, sf):
    """The rows that the stale copy lacks, appended to a target that holds the others."""
    r, target = fx.replication(spark, sf), _target(spark)
    target.overwrite(r.dst)
    target.append(kd.delete_by_keys(r.orders, r.dst.select(KEY), KEY))
    return target.read()


@query
def cluster_by_key(spark, sf):
    """The lines as an extract in key order."""
    return stage(clustered(fx.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]), fresh_folder(spark, "extract"))


@query
def tsv_roundtrip(spark, sf):
    """Text files of all documents, read back line by line."""
    path = fresh_folder(spark, "tsv")
    write_tsv(fx.table(spark, sf, "documents"), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


ORDERS = Mapping(1, 1, "orders", "srcdb", "dbo", "orders", "dstdb", "dbo", "orders_copy", (KEY,), True, True)


def _engine(
    spark: SparkSession, r: fx.Replication, target: SnapshotTarget, source: Callable[[], DataFrame] | None = None, **options
) -> SyncEngine:
    """An engine over the orders; ``source`` in place of the live source after the changes."""
    store = ControlStore(spark, fresh_folder(spark, "control"))
    ends = Endpoints(source or (lambda: r.src), lambda: r.chg, target)
    return SyncEngine(spark, store, lambda mapping: ends, Options(feed_names=SHORT, **options))


def _checked(results) -> None:
    for result in results:
        if result.status != "SUCCESS":
            raise RuntimeError(f"{result.log_type}: {result.message}")


@query
def full_sync(spark, sf):
    r, target = fx.replication(spark, sf), _target(spark)
    _checked([_engine(spark, r, target, lambda: r.orders).full_sync(ORDERS)])
    return target.read()


@query
def passes_of_changes(spark, sf):
    """Where passes of at most an eighth of the changes end, and how many changes each holds."""
    r = fx.replication(spark, sf)
    feed = stage(r.chg, fresh_folder(spark, "feed"))
    size, passes, start = max(1, -(-feed.count() // 8)), [], None
    while (end := ch.bounded_changes(feed, start, size, SHORT)) is not None:
        window = ch.lsn_window(feed, start, end, SHORT)
        passes.append(window.select(F.lit(len(passes)).alias("pass")).groupBy("pass").agg(
            F.lit(end).alias("to_lsn"), F.count(F.lit(1)).alias("changes")
        ))
        start = end
    return reduce(DataFrame.unionByName, passes)


@query
def copy_by_passes_of_changes(spark, sf):
    """The copy after the whole feed in passes of at most a third of its changes."""
    r, target = fx.replication(spark, sf), _target(spark)
    target.overwrite(r.dst)
    engine = _engine(spark, r, target, max_changes=max(1, -(-r.chg.count() // 3)))
    while (result := engine.cdc_sync(ORDERS)).changes:
        _checked([result])
    _checked([result])
    return target.read()


class Moving:
    """Source and feed that change while a copy in chunks is under way: at the high watermark of the second chunk.

    Until then the source is the stale copy and the feed is empty. The position frozen at the start and the low watermarks of two
    chunks with one high watermark in between are the first four reads of the feed.
    """

    def __init__(self, r: fx.Replication):
        self.r, self.reads = r, 0

    def source(self) -> DataFrame:
        return self.r.src if self.reads >= 5 else self.r.dst

    def feed(self) -> DataFrame:
        self.reads += 1
        return self.r.chg if self.reads >= 5 else self.r.chg.limit(0)


@query
def full_sync_chunked(spark, sf):
    """A full sync in four chunks beside a source that changes during the second, and the change sync after it."""
    r, target = fx.replication(spark, sf), _target(spark)
    moving = Moving(r)
    store = ControlStore(spark, fresh_folder(spark, "control"))
    ends = Endpoints(moving.source, moving.feed, target)
    engine = SyncEngine(spark, store, lambda mapping: ends, Options(feed_names=SHORT, chunks=4))
    _checked(engine.sync_mapping(ORDERS))
    return target.read()


def cdc_from_middle(spark, sf, target=None):
    """Change sync of the stale copy from the middle of the feed."""
    r, target = fx.replication(spark, sf), target or _target(spark)
    target.overwrite(r.dst)
    engine = _engine(spark, r, target)
    middle = spark.range(1).select(r.from_lsn.alias("lsn")).head()["lsn"]
    engine.store.update(ORDERS.mapping_id, last_cdc_lsn=middle)
    return engine, target


@query
def cdc_sync(spark, sf):
    engine, target = cdc_from_middle(spark, sf)
    _checked([engine.cdc_sync(ORDERS)])
    return target.read()


@query
def bounded_pass(spark, sf):
    """The whole feed in passes of a bounded number of positions, a quarter of the feed each."""
    r, target = fx.replication(spark, sf), _target(spark)
    target.overwrite(r.dst)
    positions = r.chg.agg(F.count_distinct("start_lsn")).head()[0]
    engine = _engine(spark, r, target, max_positions=max(1, -(-positions // 4)))
    while (result := engine.cdc_sync(ORDERS)).changes:
        _checked([result])
    _checked([result])
    return target.read()


TABLES = [
    ORDERS,
    Mapping(2, 1, "customer", "srcdb", "dbo", "customer", "dstdb", "dbo", "customer_copy", ("c_custkey",), True, False),
    Mapping(3, 1, "events", "srcdb", "dbo", "events", "dstdb", "dbo", "events_copy", ("event_id",), True, False),
    Mapping(4, 1, "absent", "srcdb", "dbo", "absent", "dstdb", "dbo", "absent_copy", ("id",), True, True),
]


def _engine_of_tables(spark, sf, orders=lambda r: r.orders) -> SyncEngine:
    """One engine over several tables; the source of the last mapping does not exist."""
    r = fx.replication(spark, sf)
    sources = {1: lambda: orders(r), **{m.mapping_id: partial(fx.table, spark, sf, m.flow_name) for m in TABLES[1:]}}
    ends = {
        m.mapping_id: Endpoints(sources[m.mapping_id], lambda: r.chg, _target(spark, m.key)) for m in TABLES
    }
    store = ControlStore(spark, fresh_folder(spark, "control"))
    return SyncEngine(spark, store, lambda mapping: ends[mapping.mapping_id], Options(feed_names=SHORT))


def _log_rows(engine: SyncEngine) -> DataFrame:
    return engine.store.logs().select("mapping_id", "log_type", "status", "records_count")


@query
def sync_all(spark, sf):
    """Log rows of all mappings; the one that fails stops no other, and its change sync waits for the full sync."""
    engine = _engine_of_tables(spark, sf)
    engine.sync_all(TABLES)
    return _log_rows(engine)


@query
def verify_all(spark, sf):
    """Log rows of the verification of all copies; that of orders is stale."""
    engine = _engine_of_tables(spark, sf, lambda r: r.src)
    r = fx.replication(spark, sf)
    for mapping in TABLES[:-1]:
        ends = engine.locate(mapping)
        ends.target.overwrite(r.dst if mapping is ORDERS else ends.source())
    engine.verify_all(TABLES[:-1])
    return _log_rows(engine)


@query
def verify_whole(spark, sf):
    """What the whole-table verification of the stale copy reports."""
    r, target = fx.replication(spark, sf), _target(spark)
    target.overwrite(r.dst)
    engine = _engine(spark, r, target)
    engine.verify_whole(ORDERS)
    found = F.regexp_extract("log_message", "Tables differ: ([^;]*)", 1)
    return engine.store.logs().select("log_type", "status", found.alias("differences"))


@query
def run_logs(spark, sf):
    """Log rows of a full sync, the change sync after it and a verification."""
    r, target = fx.replication(spark, sf), _target(spark)
    engine = _engine(spark, r, target, lambda: r.orders)
    _checked([*engine.sync_mapping(ORDERS), engine.verify(ORDERS)])
    return engine.store.logs().select("flow_id", "mapping_id", "log_type", "status", "records_count")


@query
def run_state(spark, sf):
    """State of a mapping after change sync from the middle of the feed."""
    engine, _ = cdc_from_middle(spark, sf)
    _checked([engine.cdc_sync(ORDERS)])
    state = engine.store.states()
    return state.select("mapping_id", "last_cdc_lsn", F.col("last_cdc_sync_at").isNotNull().alias("has_sync_time"))


@query
def target_passes(spark, sf):
    """The feed in three windows that overlap, one pass each."""
    r, target = fx.replication(spark, sf), _target(spark)
    target.overwrite(r.dst)
    for window in (ch.lsn_window(r.chg, None, r.from_lsn, SHORT), _later(r), r.chg):
        keys, stats = stage_keys(window, KEY, fresh_folder(spark, "keys"))
        target.replace_by_keys(r.src, keys, stats=stats)
    return target.read()


def _run_stream(spark, sf, mode):
    r, target = fx.replication(spark, sf), _target(spark)
    target.overwrite(r.dst)
    feed = fresh_folder(spark, "feed")
    r.chg.repartitionByRange(4, "start_lsn").write.parquet(feed)
    stream = spark.readStream.schema(r.chg.schema).option("maxFilesPerTrigger", 2).parquet(feed)
    run = start_stream(
        stream, lambda: r.src, target, fresh_folder(spark, "checkpoint"), mode=mode, trigger=None, names=SHORT
    )
    run.awaitTermination()
    return target.read()


@query
def stream_sync(spark, sf):
    return _run_stream(spark, sf, "replace")


@query
def stream_sync_ops(spark, sf):
    return _run_stream(spark, sf, "ops")


@query
def stream_sync_with_full_sync(spark, sf):
    """A stream whose first batch finds a full sync requested: the copy is that of the middle of the feed, the stream goes on."""
    r, target = fx.replication(spark, sf), _target(spark)
    feed = fresh_folder(spark, "feed")
    r.chg.repartitionByRange(4, "start_lsn").write.parquet(feed)
    first = ch.lsn_window(r.chg, None, r.from_lsn, SHORT)
    middle = stage(kd.replace_by_keys(r.dst, r.src, kd.changed_keys(first, KEY), KEY), fresh_folder(spark, "middle"))
    ends = Endpoints(lambda: middle, lambda: first, target)
    engine = SyncEngine(spark, ControlStore(spark, fresh_folder(spark, "control")), lambda mapping: ends, Options(feed_names=SHORT))
    stream = spark.readStream.schema(r.chg.schema).option("maxFilesPerTrigger", 2).parquet(feed)
    run = start_stream(
        stream, lambda: r.src, target, fresh_folder(spark, "checkpoint"), trigger=None, names=SHORT, engine=engine, mapping=ORDERS
    )
    run.awaitTermination()
    return target.read()


# ---- control plane -----------------------------------------------------------------------------------------------


@query
def enabled_mappings(spark, sf):
    found = ct.enabled_mappings(fx.mappings(spark, sf), fx.flows(spark, sf))
    return found.select("mapping_id", "flow_id", "flow_name", "source_table", "dest_table", "last_cdc_lsn")


@query
def route_mappings(spark, sf):
    routed = ct.route_mappings(ct.enabled_mappings(fx.mappings(spark, sf), fx.flows(spark, sf)))
    return routed.select("mapping_id", "is_full_sync", "cdc_enabled", "action")


@query
def verifiable_mappings(spark, sf):
    enabled = ct.enabled_mappings(fx.mappings(spark, sf), fx.flows(spark, sf))
    running = fx.mappings(spark, sf).where(F.col("mapping_id") % 4 == 0)
    return ct.verifiable_mappings(enabled, running).select("mapping_id", "flow_name")


@query
def mapping_descriptor(spark, sf):
    return ct.mapping_descriptor(fx.mappings(spark, sf), fx.flows(spark, sf))


@query
def log_messages(spark, sf):
    return ct.log_messages(fx.mappings(spark, sf), fx.flows(spark, sf), "Full sync started")


@query
def generated_columns(spark, sf):
    return ct.generated_columns(fx.mappings(spark, sf), *fx.column_catalogues(spark, sf))


@query
def resolve_feeds(spark, sf):
    """The change tables of all mappings from catalogue tables: none, one, or the first of two."""
    return rg.resolve_feeds(*fx.feed_catalogues(spark, sf))


@query
def feed_warnings(spark, sf):
    maps, databases, tables = fx.feed_catalogues(spark, sf)
    return rg.feed_warnings(rg.resolve_feeds(maps, databases, tables), maps)


@query
def mappings_with_states(spark, sf):
    """The enabled mappings after a change sync of the first one: its position is the end of the feed."""
    engine, _ = cdc_from_middle(spark, sf)
    _checked([engine.cdc_sync(ORDERS)])
    now = ct.with_states(fx.mappings(spark, sf), engine.store.states())
    return ct.enabled_mappings(now, fx.flows(spark, sf)).select("mapping_id", "is_full_sync", "last_cdc_lsn")


@query
def state_update(spark, sf):
    enabled = ct.enabled_mappings(fx.mappings(spark, sf), fx.flows(spark, sf))
    newest = ch.lsn_bounds(fx.replication(spark, sf).chg, SHORT).select("max_lsn").scalar()
    updates = enabled.where("cdc_enabled").select("mapping_id", newest.alias("last_cdc_lsn"))
    return ct.update_state(enabled.select("mapping_id", "is_full_sync", "last_cdc_lsn"), updates)


@query
def recent_logs(spark, sf):
    return ct.recent_logs(fx.logs(spark, sf), fx.mappings(spark, sf), fx.flows(spark, sf))


@query
def recent_logs_literal(spark, sf):
    return ct.recent_logs(fx.logs(spark, sf), fx.mappings(spark, sf), fx.flows(spark, sf), literal=True)


@query
def recent_errors(spark, sf):
    return ct.recent_errors(fx.logs(spark, sf), fx.mappings(spark, sf), fx.flows(spark, sf))


@query
def sync_summary(spark, sf):
    return ct.sync_summary(fx.logs(spark, sf), fx.mappings(spark, sf))


@query
def sync_summary_incremental(spark, sf):
    """The summary from a stream of the log in several batches, partials merged on the way."""
    feed = fresh_folder(spark, "log")
    logs = fx.logs(spark, sf)
    logs.repartitionByRange(5, "log_id").write.parquet(feed)
    stream = spark.readStream.schema(logs.schema).option("maxFilesPerTrigger", 1).parquet(feed)
    store = SummaryStore(spark, fresh_folder(spark, "summary"), merge_every=3)
    summary_stream(stream, store, fresh_folder(spark, "checkpoint"), trigger=None).awaitTermination()
    return store.summary(fx.mappings(spark, sf))
