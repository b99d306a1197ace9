"""The registered queries over the driver's tables, each beside the DuckDB SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..functions.checksum import checksum
from ..functions.records import BITS_PER_KEY, MULTIPLIER, SEED
from ..operators import batch, levels, manifest, picking, resolve
from ..operators.intervals import ordered
from ..sources import formats, paths
from ..sources import oplog as src
from ..sources.store import Options, Store
from ..streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Parameters of the queries.
KEY, ABSENT, SNAP, LOW, HIGH, SEEK = "000007", "network", 600, "000020", "000060", "0000405"
BUFFER, LEVEL1, SMALL_FILE = 16 << 10, 4000, 6000
KEYS = ["000003", "000007", "000011", "000019", "999999"]

OPLOG = f"""oplog AS (SELECT lpad(CAST(user_id AS VARCHAR), 6, '0') AS k, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS vtype,
  CASE WHEN event_type <> 'error' THEN props END AS v, event_id // {src.BATCH} AS batch_id FROM events)"""
NEWEST = OPLOG + ", newest AS (SELECT * FROM oplog QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq DESC) = 1)"
PLACED = OPLOG + """, leveled AS (SELECT *, CAST(batch_id % 4 AS INT) AS level FROM oplog),
  placed AS (SELECT *, level * 1000 + (CAST(k AS BIGINT) // (10 + 5 * level)) * 2 + 1 + CASE WHEN level = 0 THEN (batch_id // 4) % 2 ELSE 0 END AS number FROM leveled)"""
FILES = PLACED + """, files AS (SELECT level, number, min(k) AS smallest, max(k) AS largest, min(seq) AS min_seq, max(seq) AS max_seq, count(*) AS entries,
  CAST(sum(strlen(k) + coalesce(strlen(v), 0) + 8) AS BIGINT) AS size FROM placed GROUP BY level, number)"""
EDITS = FILES + """, edits AS (SELECT number % 5 + 1 AS edit_id, 1 AS is_add, level, number FROM files UNION ALL SELECT 3, 0, level, number FROM files WHERE number % 3 = 0
  UNION ALL SELECT 3, 1, level, number FROM files WHERE number % 6 = 0)"""
COLS = "k, seq, vtype, v, batch_id"


def vlen(x: str) -> str:
    return f"(CASE WHEN {x} < 128 THEN 1 WHEN {x} < 16384 THEN 2 WHEN {x} < 2097152 THEN 3 WHEN {x} < 268435456 THEN 4 WHEN {x} < 34359738368 THEN 5 ELSE 6 END)"


SIZED = OPLOG + f", sized AS (SELECT *, CAST(1 + {vlen('strlen(k)')} + strlen(k) + CASE WHEN vtype = 1 THEN {vlen('strlen(v)')} + strlen(v) ELSE 0 END AS BIGINT) AS bytes FROM oplog)"
BATCHES = SIZED + f", batches AS (SELECT batch_id, min(seq) AS base, max(seq) AS last_seq, count(*) AS ops, CAST(sum(bytes) + {batch.HEADER} AS BIGINT) AS bytes FROM sized GROUP BY batch_id)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def simple(name: str, sql: str, f: Callable[[DataFrame], DataFrame], source: Query = src.oplog) -> None:
    """A query over one view."""
    query(name, sql)(lambda spark, sf_dir: f(source(spark, sf_dir)))


# reads

simple("q01_get_point", f"WITH {OPLOG} SELECT {COLS} FROM (SELECT * FROM oplog WHERE k = '{KEY}' ORDER BY seq DESC LIMIT 1) WHERE vtype = 1", lambda d: resolve.get(d, KEY))
simple("q02_multi_get", f"WITH {NEWEST} SELECT {COLS} FROM newest WHERE vtype = 1 AND k IN {tuple(KEYS)}", lambda d: resolve.multi_get(d, KEYS))
simple("q03_get_missing", f"WITH {NEWEST} SELECT '{ABSENT}' AS k, count(*) AS found FROM newest WHERE vtype = 1 AND k = '{ABSENT}'", lambda d: resolve.get(d, ABSENT).agg(F.count("*").alias("found")).select(F.lit(ABSENT).alias("k"), "found"))
simple("q04_get_at_snapshot", f"WITH {OPLOG} SELECT {COLS} FROM (SELECT * FROM oplog WHERE seq <= {SNAP} QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq DESC) = 1) WHERE vtype = 1", lambda d: resolve.latest(d, SNAP))
simple("q05_latest_state", f"WITH {NEWEST} SELECT {COLS} FROM newest WHERE vtype = 1", resolve.latest)
simple("q06_deleted_keys", f"WITH {NEWEST} SELECT k, seq FROM newest WHERE vtype = 0", lambda d: resolve.deleted(d).select("k", "seq"))
simple("q07_range_scan", f"WITH {NEWEST} SELECT {COLS} FROM newest WHERE vtype = 1 AND k BETWEEN '{LOW}' AND '{HIGH}'", lambda d: resolve.scan(d, LOW, HIGH))
simple("q08_seek_lower_bound", f"WITH {NEWEST} SELECT {COLS} FROM newest WHERE vtype = 1 AND k >= '{SEEK}' ORDER BY k LIMIT 1", lambda d: resolve.seek(d, SEEK))
simple("q09_first_n", f"WITH {NEWEST} SELECT {COLS} FROM newest WHERE vtype = 1 ORDER BY k LIMIT 10", lambda d: resolve.first_n(d, 10))
simple("q10_last_n", f"WITH {NEWEST} SELECT {COLS} FROM newest WHERE vtype = 1 ORDER BY k DESC LIMIT 10", lambda d: resolve.last_n(d, 10))
simple("q11_version_history", f"WITH {OPLOG} SELECT {COLS}, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS version FROM oplog", resolve.history)

# batches

simple("q12_batch_expand", f"WITH {OPLOG} SELECT seq, k, vtype, v, seq - min(seq) OVER (PARTITION BY batch_id) AS pos FROM oplog", lambda d: batch.expand(batch.collect(d)).withColumn("pos", F.col("pos").cast("long")))
simple("q13_batch_stats", f"WITH {BATCHES} SELECT * FROM batches", batch.stats)
simple(
    "q14_group_commit",
    f"""WITH {BATCHES}, queue AS (SELECT *, CAST(sum(bytes) OVER (ORDER BY batch_id) AS BIGINT) AS running, first(bytes) OVER (ORDER BY batch_id) AS fb FROM batches WHERE batch_id >= 5)
    SELECT batch_id, base, last_seq, ops, bytes, running FROM queue WHERE running <= CASE WHEN fb <= {batch.SMALL_LEADER} THEN fb + {batch.SMALL_LEADER} ELSE {batch.GROUP_CAP} END OR batch_id = 5""",
    lambda d: batch.commit_group(batch.stats(d), 5),
)
simple(
    "q12b_batch_extend",
    f"WITH {OPLOG}, g AS (SELECT *, batch_id // 3 AS three FROM oplog) SELECT min(seq) OVER (PARTITION BY three) AS base, row_number() OVER (PARTITION BY three ORDER BY seq) - 1 AS pos, k, vtype, v FROM g",
    lambda d: batch.expand(batch.extend(batch.collect(d).withColumn("three", F.expr("batch_id div 3")), "three")).select((F.col("seq") - F.col("pos")).alias("base"), F.col("pos").cast("long").alias("pos"), "k", "vtype", "v"),
)
simple(
    "q14b_group_commit_sync",
    f"""WITH {BATCHES}, queue AS (SELECT *, CAST(sum(bytes) OVER (ORDER BY batch_id) AS BIGINT) AS running, first(bytes) OVER (ORDER BY batch_id) AS fb, batch_id % 7 = 0 AS sync FROM batches WHERE batch_id >= 8),
    stop AS (SELECT min(batch_id) AS first_sync FROM queue WHERE sync) SELECT batch_id, base, last_seq, ops, bytes, running, sync FROM queue, stop WHERE running <= fb + {batch.SMALL_LEADER} AND (first_sync IS NULL OR batch_id < first_sync) OR batch_id = 8""",
    lambda d: batch.commit_group(batch.stats(d).withColumn("sync", F.col("batch_id") % 7 == 0), 8),
)
simple("q15_memtable_rotation", f"WITH {SIZED}, r AS (SELECT *, bytes + 8 AS charge, CAST(sum(bytes + 8) OVER (ORDER BY seq) AS BIGINT) AS running FROM sized) SELECT k, seq, charge, running, (running - charge) // {BUFFER} AS buffer FROM r", lambda d: batch.rotations(d, BUFFER).select("k", "seq", "charge", "running", "buffer"))
simple(
    "q16_empty_value_delete",
    f"WITH {OPLOG}, e AS (SELECT k, seq, batch_id, CASE WHEN seq % 5 = 0 THEN '' ELSE v END AS v FROM oplog) SELECT {COLS} FROM (SELECT k, seq, CASE WHEN coalesce(v, '') = '' THEN 0 ELSE 1 END AS vtype, v, batch_id FROM e QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq DESC) = 1) WHERE vtype = 1",
    lambda d: resolve.latest(resolve.normalized(d.withColumn("v", F.when(F.col("seq") % 5 == 0, "").otherwise(F.col("v"))))),
)
simple(
    "q17_dup_insert_first_wins",
    f"WITH {OPLOG}, d AS (SELECT k, seq // 7 AS seq, v, seq AS pos FROM oplog) SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY k, seq ORDER BY pos) = 1",
    lambda d: resolve.first_of_duplicates(d.select("k", F.expr("seq div 7").alias("seq"), "v", F.col("seq").alias("pos"))),
)

# merge and compaction

simple(
    "q18_merge_runs",
    f"""WITH {OPLOG}, r AS (SELECT *, 0 AS run FROM oplog WHERE seq % 3 = 0 UNION ALL SELECT k, seq, vtype, 'second', batch_id, 1 FROM oplog WHERE seq % 2 = 0 UNION ALL SELECT k, seq, vtype, 'third', batch_id, 2 FROM oplog)
    SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY k, seq ORDER BY run) = 1""",
    lambda d: resolve.merge([d.where("seq % 3 = 0"), d.where("seq % 2 = 0").withColumn("v", F.lit("second")), d.withColumn("v", F.lit("third"))]),
)
simple("q19_compaction_gc", f"WITH {OPLOG} SELECT {COLS} FROM (SELECT *, lag(seq) OVER (PARTITION BY k ORDER BY seq DESC) AS newer FROM oplog) WHERE newer IS NULL OR newer > {SNAP}", lambda d: resolve.compacted(d, SNAP))


@query("q20_tombstone_elision", f"""WITH {FILES}, g AS (SELECT * FROM placed WHERE level <= 1 QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq DESC) = 1)
  SELECT k, seq, vtype, v FROM g WHERE vtype = 1 OR EXISTS (SELECT 1 FROM files f WHERE f.level >= 2 AND g.k BETWEEN f.smallest AND f.largest)""")
def q20(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resolve.newest(src.placed(spark, sf_dir).where("level <= 1"))
    deeper = src.files(spark, sf_dir).where("level >= 2")
    return resolve.elide_tombstones(rows.select("k", "seq", "vtype", "v"), deeper, resolve.MAX_SEQ)


simple(
    "q21_gc_dropped_count",
    f"WITH {OPLOG}, g AS (SELECT *, coalesce(lag(seq) OVER (PARTITION BY k ORDER BY seq DESC) <= {SNAP}, false) AS dropped FROM oplog) SELECT dropped, vtype, count(*) AS n FROM g GROUP BY dropped, vtype",
    lambda d: resolve.collectable(d, SNAP).groupBy("dropped", "vtype").agg(F.count("*").alias("n")),
)

# files and levels

simple("q22_file_zone_map", f"WITH {FILES} SELECT * FROM files", lambda d: d, src.files)
ROUTED = f"WITH {FILES}, keys AS (SELECT DISTINCT k FROM oplog), routed AS (SELECT k, level, number, row_number() OVER (PARTITION BY k ORDER BY level, number DESC) AS probe FROM keys JOIN files ON k BETWEEN smallest AND largest)"
query("q23_key_to_file_routing", ROUTED + " SELECT * FROM routed")(lambda s, d: levels.route(src.oplog(s, d).select("k").distinct(), src.files(s, d)))
AMP = ROUTED + ", amp AS (SELECT k, count(*) AS probed, CASE WHEN count(*) > 1 THEN min(number) FILTER (probe = 1) END AS charged FROM routed GROUP BY k)"
query("q24_read_amplification", AMP + " SELECT * FROM amp")(lambda s, d: levels.read_amplification(src.oplog(s, d).select("k").distinct(), src.files(s, d)))
query("q24b_seek_charges", AMP + f", c AS (SELECT charged AS number, count(*) AS charges FROM amp WHERE charged IS NOT NULL GROUP BY charged) SELECT number, charges, greatest({levels.SEEK_LEAST}, size // {levels.SEEK_BYTES}) AS allowed_seeks, charges >= greatest({levels.SEEK_LEAST}, size // {levels.SEEK_BYTES}) AS exhausted FROM c JOIN files USING (number)")(
    lambda s, d: levels.seek_charges(src.oplog(s, d).select("k").distinct(), src.files(s, d))
)
simple("q25_overlap_in_level", f"WITH {FILES} SELECT count(*) > 0 AS overlaps FROM files WHERE level = 1 AND largest >= '{LOW}' AND smallest <= '{HIGH}'", lambda d: levels.has_overlap(d, 1, LOW, HIGH), src.files)
query("q25b_exists_in_level", f"WITH {FILES} SELECT DISTINCT k FROM oplog WHERE EXISTS (SELECT 1 FROM files WHERE level = 2 AND k BETWEEN smallest AND largest)")(lambda s, d: levels.key_exists(src.oplog(s, d).select("k").distinct(), src.files(s, d), 2))
simple("q26_overlapping_inputs", f"WITH {FILES} SELECT * FROM files WHERE level = 2 AND largest >= '{LOW}' AND smallest <= '{HIGH}'", lambda d: levels.overlapping_inputs(d, 2, LOW, HIGH), src.files)
ISLANDS = f"""WITH {FILES}, l0 AS (SELECT *, max(largest) OVER (ORDER BY smallest, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM files WHERE level = 0),
  isl AS (SELECT *, CAST(sum(CASE WHEN smallest <= reach THEN 0 ELSE 1 END) OVER (ORDER BY smallest, number ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM l0)"""
simple("q27_l0_closure", ISLANDS + f" SELECT level, number, smallest, largest, min_seq, max_seq, entries, size FROM isl WHERE island IN (SELECT island FROM isl WHERE largest >= '000041' AND smallest <= '000043')", lambda d: levels.closure(d, "000041", "000043"), src.files)
simple("q27b_l0_islands", ISLANDS + " SELECT number, island FROM isl", lambda d: levels.islands(d).select("number", "island"), src.files)
STATS = FILES + ", stats AS (SELECT CAST(s.level AS INT) AS level, count(number) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM range(7) s(level) LEFT JOIN files USING (level) GROUP BY s.level)"
simple("q28_level_summary", f"WITH {STATS} SELECT * FROM stats", levels.level_stats, src.files)
SCORES = STATS + f", scores AS (SELECT *, CASE WHEN level = 0 THEN files * 1000000 // {levels.START} ELSE bytes * 1000000 // ({LEVEL1} * CAST(power({levels.GROWTH}, level - 1) AS BIGINT)) END AS score_millionths FROM stats WHERE level < 6)"
simple("q29_compaction_score", f"WITH {SCORES} SELECT * FROM scores", lambda d: levels.scores(d, LEVEL1), src.files)
simple("q30_pick_level", f"WITH {SCORES} SELECT *, score_millionths >= 1000000 AS needed FROM scores ORDER BY score_millionths DESC, level LIMIT 1", lambda d: levels.best_level(d, LEVEL1), src.files)
query("q30b_needs_compaction", f"WITH {SCORES}, {AMP.removeprefix(f'WITH {FILES}, ')}" + f""", c AS (SELECT charged AS number, count(*) AS charges FROM amp WHERE charged IS NOT NULL GROUP BY charged),
  two AS (SELECT (SELECT max(score_millionths) >= 1000000 FROM scores) AS by_size, coalesce((SELECT bool_or(charges >= greatest({levels.SEEK_LEAST}, size // {levels.SEEK_BYTES})) FROM c JOIN files USING (number)), false) AS by_seeks) SELECT *, by_size OR by_seeks AS needed FROM two""")(
    lambda s, d: levels.needs_compaction(src.files(s, d), src.oplog(s, d).select("k").distinct(), LEVEL1)
)
simple("q31_pick_by_pointer", f"WITH {FILES} SELECT * FROM files WHERE level = 1 ORDER BY CASE WHEN largest <= '{HIGH}' THEN 1 ELSE 0 END, smallest, number LIMIT 1", lambda d: levels.pick_by_pointer(d, 1, HIGH), src.files)
simple("q32_manual_cut", f"WITH {FILES}, m AS (SELECT *, CAST(coalesce(sum(size) OVER (ORDER BY smallest, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM files WHERE level = 1 AND largest >= '{LOW}') SELECT * FROM m WHERE before < {SMALL_FILE}", lambda d: levels.manual_inputs(d, 1, LOW, "999999", SMALL_FILE), src.files)
simple(
    "q33_trivial_move",
    f"""WITH {FILES}, t AS (SELECT f.level, f.number, (SELECT count(*) FROM files g WHERE g.level = f.level + 1 AND f.smallest <= g.largest AND f.largest >= g.smallest) AS next_files,
    (SELECT CAST(coalesce(sum(g.size), 0) AS BIGINT) FROM files g WHERE g.level = f.level + 2 AND f.smallest <= g.largest AND f.largest >= g.smallest) AS grand_bytes FROM files f WHERE f.level < 6)
    SELECT *, next_files = 0 AND grand_bytes <= {levels.GRANDPARENTS * 500} AS trivial FROM t""",
    lambda d: levels.trivial_moves(d, 500),
    src.files,
)
FLUSH = """SELECT '{case}' AS place, CAST(CASE WHEN coalesce(sum(n) FILTER (level = 0), 0) > 0 OR coalesce(sum(n) FILTER (level = 1), 0) > 0 OR coalesce(sum(z) FILTER (level = 2), 0) > 2097152 THEN 0
    WHEN coalesce(sum(n) FILTER (level = 2), 0) > 0 OR coalesce(sum(z) FILTER (level = 3), 0) > 2097152 THEN 1 ELSE 2 END AS INT) AS flush_level
    FROM (SELECT level, count(*) AS n, sum(size) AS z FROM files WHERE level >= {least} AND largest >= '{low}' AND smallest <= '{high}' GROUP BY level)"""
#: Ranges of flushed runs, and the first level that has files.
FLUSHES = [("inside", 0, LOW, HIGH), ("beyond", 0, "999998", "999999"), ("above level 1", 1, LOW, HIGH), ("above level 2", 2, LOW, HIGH), ("above level 3", 3, LOW, HIGH)]


@query("q34_flush_level", f"WITH {FILES} " + " UNION ALL ".join(FLUSH.format(case=c, least=n, low=a, high=b) for c, n, a, b in FLUSHES))
def q34(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, out = src.files(spark, sf_dir), None
    for case, least, low, high in FLUSHES:
        one = levels.flush_level(files.where(F.col("level") >= least), low, high).select(F.lit(case).alias("place"), "flush_level")
        out = one if out is None else out.union(one)
    return out


query("q34b_grandparent_cuts", f"""WITH RECURSIVE {FILES}, keys AS (SELECT k, seq FROM placed WHERE level = 1),
  passed AS (SELECT (SELECT min(k) FROM keys WHERE k > f.largest) AS k, size FROM files f WHERE level = 3),
  steps AS (SELECT k, CAST(sum(size) AS BIGINT) AS size, row_number() OVER (ORDER BY k) AS n FROM passed WHERE k > (SELECT min(k) FROM keys) GROUP BY k),
  fold AS (SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS held, CAST(NULL AS VARCHAR) AS cut UNION ALL
    SELECT s.n, CASE WHEN held + size > {SMALL_FILE} THEN 0 ELSE held + size END, CASE WHEN held + size > {SMALL_FILE} THEN k END FROM fold JOIN steps s ON s.n = fold.n + 1)
  SELECT k, seq, CAST((SELECT count(*) FROM fold WHERE cut <= keys.k) AS INT) AS output FROM keys""")(
    lambda s, d: levels.cut_points(src.placed(s, d).where("level = 1").select("k", "seq"), src.files(s, d).where("level = 3"), SMALL_FILE)
)
PICKED = ISLANDS.replace("WITH ", "WITH RECURSIVE ", 1) + f""", stats AS (SELECT CAST(s.level AS INT) AS level, count(number) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM range(6) s(level) LEFT JOIN files USING (level) GROUP BY s.level),
  best AS (SELECT level FROM stats ORDER BY CASE WHEN level = 0 THEN files * 1000000 // {levels.START} ELSE bytes * 1000000 // ({LEVEL1} * CAST(power({levels.GROWTH}, level - 1) AS BIGINT)) END DESC, level LIMIT 1),
  one AS (SELECT f.* FROM files f, best WHERE f.level = best.level ORDER BY CASE WHEN largest <= '{HIGH}' THEN 1 ELSE 0 END, smallest, number LIMIT 1),
  a AS (SELECT f.* FROM files f, one WHERE f.level = one.level AND (f.number = one.number OR f.level = 0 AND f.number IN (SELECT number FROM isl WHERE island = (SELECT island FROM isl JOIN one o USING (number))))),
  ar AS (SELECT min(smallest) AS lo, max(largest) AS hi, any_value(level) AS level, sum(size) AS z, count(*) AS n FROM a),
  b AS (SELECT f.* FROM files f, ar WHERE f.level = ar.level + 1 AND f.largest >= lo AND f.smallest <= hi),
  abr AS (SELECT least(min(b.smallest), any_value(lo)) AS lo, greatest(max(b.largest), any_value(hi)) AS hi, count(b.number) AS n, coalesce(sum(b.size), 0) AS z FROM ar LEFT JOIN b ON true),
  wide AS (SELECT f.* FROM files f, ar, abr WHERE f.level = ar.level AND f.level > 0 AND f.largest >= abr.lo AND f.smallest <= abr.hi UNION ALL SELECT * FROM a WHERE level = 0),
  wr AS (SELECT min(smallest) AS lo, max(largest) AS hi, count(*) AS n, sum(size) AS z FROM wide),
  grows AS (SELECT abr.n > 0 AND wr.n > ar.n AND wr.z + abr.z < {levels.EXPANSION * SMALL_FILE} AND (SELECT count(*) FROM files f WHERE f.level = ar.level + 1 AND f.largest >= wr.lo AND f.smallest <= wr.hi) = abr.n AS yes FROM ar, abr, wr),
  p AS (SELECT 'input' AS part, number FROM wide, grows WHERE yes UNION ALL SELECT 'input', number FROM a, grows WHERE NOT yes UNION ALL SELECT 'next', number FROM b),
  r AS (SELECT min(smallest) AS lo, max(largest) AS hi FROM files WHERE number IN (SELECT number FROM p))
  SELECT * FROM p UNION ALL SELECT 'beneath', number FROM files f, ar, r WHERE f.level = ar.level + 2 AND f.largest >= r.lo AND f.smallest <= r.hi"""


@query("q55_picked_compaction", PICKED)
def q55(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole choice of a compaction over the file table: level, file, closure, next level, expansion, beneath."""
    files = [r.asDict() for r in src.files(spark, sf_dir).collect()]  # metadata, as the driver holds it
    c = picking.pick(files, {n: HIGH for n in range(levels.LEVELS)}, SMALL_FILE, LEVEL1)
    parts = (("input", c.inputs), ("next", c.lower), ("beneath", c.grandparents)) if c else ()  # no level may be due
    return spark.createDataFrame([(part, f["number"]) for part, fs in parts for f in fs], "part string, number long")


# manifest

LIVE = EDITS + ", live AS (SELECT level, number, edit_id FROM (SELECT *, row_number() OVER (PARTITION BY level, number ORDER BY edit_id DESC, is_add DESC) AS r FROM edits) WHERE r = 1 AND is_add = 1)"
simple("q35_manifest_fold", f"WITH {LIVE} SELECT * FROM live", manifest.fold, src.edits)
simple("q35b_edit_summary", f"WITH {EDITS} SELECT edit_id, string_agg(t, ' ' ORDER BY t) AS summary FROM (SELECT edit_id, CASE WHEN is_add = 1 THEN '+' ELSE '-' END || level || '-' || number AS t FROM edits) GROUP BY edit_id", manifest.summary, src.edits)
query("q36b_new_version", f"""WITH {EDITS}, base AS (SELECT level, number FROM files WHERE level >= 1), last AS (SELECT level, number, max_by(is_add, 2 * edit_id + is_add) AS is_add FROM edits GROUP BY level, number)
  SELECT level, number FROM last WHERE is_add = 1 UNION SELECT level, number FROM base ANTI JOIN last USING (level, number)""")(
    lambda s, d: manifest.apply(src.files(s, d).where("level >= 1"), src.edits(s, d))
)
query("q36_live_files", f"WITH {LIVE} SELECT number FROM live UNION SELECT number FROM files WHERE level = 2")(lambda s, d: manifest.live(manifest.fold(src.edits(s, d)), src.files(s, d).where("level = 2")))
LISTING = "names AS (SELECT CASE i % 4 WHEN 0 THEN lpad(CAST(i AS VARCHAR), 6, '0') || '.ldb' WHEN 1 THEN lpad(CAST(i AS VARCHAR), 6, '0') || '.log' WHEN 2 THEN 'MANIFEST-' || lpad(CAST(i AS VARCHAR), 6, '0') ELSE lpad(CAST(i AS VARCHAR), 6, '0') || CASE WHEN i % 8 = 3 THEN '.sst' ELSE '.dbtmp' END END AS name FROM (SELECT DISTINCT user_id AS i FROM events) UNION ALL SELECT 'CURRENT' UNION ALL SELECT 'LOCK' UNION ALL SELECT 'notes.txt')"
PARSED = LISTING + """, parsed AS (SELECT name, CASE WHEN name = 'CURRENT' THEN 'current' WHEN name = 'LOCK' THEN 'lock' WHEN regexp_full_match(name, 'MANIFEST-[0-9]+') THEN 'manifest' WHEN regexp_full_match(name, '[0-9]+[.]log') THEN 'log'
  WHEN regexp_full_match(name, '[0-9]+[.](ldb|sst)') THEN 'table' WHEN regexp_full_match(name, '[0-9]+[.]dbtmp') THEN 'temp' END AS kind, CAST(nullif(regexp_extract(name, '([0-9]+)', 1), '') AS BIGINT) AS number FROM names)"""


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a made-up directory, one per user and three more."""
    i = src.table(spark, sf_dir, "events").select(F.col("user_id").alias("i")).distinct()
    six = F.lpad(F.col("i").cast("string"), 6, "0")
    tail = F.when(F.col("i") % 8 == 3, ".sst").otherwise(".dbtmp")
    name = F.when(F.col("i") % 4 == 0, F.concat(six, F.lit(".ldb"))).when(F.col("i") % 4 == 1, F.concat(six, F.lit(".log"))).when(F.col("i") % 4 == 2, F.concat(F.lit("MANIFEST-"), six)).otherwise(F.concat(six, tail))
    return i.select(name.alias("name")).union(spark.range(1).select(F.explode(F.lit(["CURRENT", "LOCK", "notes.txt"]))))


def in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.table(spark, sf_dir, "events").select(F.col("user_id").alias("number")).distinct().where("number % 3 = 0")


USED = ", used AS (SELECT DISTINCT user_id AS number FROM events WHERE user_id % 3 = 0)"
query("q37_obsolete", f"WITH {PARSED}{USED} SELECT name, kind, number FROM parsed WHERE (kind IN ('table', 'temp') AND number NOT IN (SELECT number FROM used)) OR (kind = 'manifest' AND number < 40) OR (kind = 'log' AND number < 60)")(lambda s, d: manifest.obsolete(listing(s, d), in_use(s, d), 40, 60))
query("q38_missing", f"WITH {PARSED}{USED} SELECT number FROM used WHERE number NOT IN (SELECT number FROM parsed WHERE kind = 'table')")(lambda s, d: manifest.missing(listing(s, d), in_use(s, d)))
simple("q39_allowed_seeks", f"WITH {FILES} SELECT number, greatest({levels.SEEK_LEAST}, size * 1000 // {levels.SEEK_BYTES}) AS allowed_seeks FROM files", lambda d: levels.allowed_seeks(d.withColumn("size", F.col("size") * 1000)).select("number", "allowed_seeks"), src.files)
simple("q40_write_state", "SELECT n, CASE WHEN n >= 12 THEN 'stop' WHEN n >= 8 THEN 'slow' WHEN n >= 4 THEN 'compact' ELSE 'free' END AS state FROM (SELECT user_id AS n FROM events GROUP BY user_id)", lambda d: d.select(F.col("user_id").alias("n")).distinct().withColumn("state", levels.write_state(F.col("n"))), lambda s, d: src.table(s, d, "events"))

# codecs

simple("q41_varint_length", f"WITH {OPLOG} SELECT seq * 977 * seq AS x, CAST({vlen('seq * 977 * seq')} AS INT) AS n FROM oplog", lambda d: d.select((F.col("seq") * 977 * F.col("seq")).alias("x")).withColumn("n", codec.varint_length("x")))
simple("q41b_varint_round_trip", f"WITH {OPLOG} SELECT seq * 977 AS x, seq * 977 AS back, CAST({vlen('seq * 977')} AS INT) AS n FROM oplog", lambda d: d.select((F.col("seq") * 977).alias("x")).withColumn("h", codec.varint_hex("x")).select("x", codec.varint_decode("h").alias("back"), F.expr("cast(length(h) / 2 as int)").alias("n")))
simple("q41c_fixed_round_trip", f"WITH {OPLOG} SELECT seq, seq AS back, right(upper(lpad(to_hex(seq), 8, '0')), 2) AS first_byte FROM oplog", lambda d: d.select("seq").withColumn("h", codec.fixed_hex("seq", 4)).select("seq", codec.fixed_decode("h", 4).alias("back"), F.substring("h", 1, 2).alias("first_byte")))
LCP = "CAST(len(list_filter(generate_series(1, least(length({a}), length({b})) // 2), lambda i: left({a}, 2 * i) = left({b}, 2 * i))) AS INT)"
simple(
    "q41d_trailer",
    f"WITH {OPLOG} SELECT seq * 70368744177 AS seq, vtype, upper(lpad(to_hex(vtype), 2, '0')) AS kind, upper(right(lpad(to_hex(seq * 70368744177), 14, '0'), 2)) AS first_byte, upper(left(lpad(to_hex(seq * 70368744177), 14, '0'), 2)) AS last_byte FROM oplog",
    lambda d: d.select((F.col("seq") * 70368744177).alias("seq"), "vtype").withColumn("h", codec.trailer_hex("seq", "vtype")).withColumn("back", codec.trailer_decode("h"))
    .select("back.seq", "back.vtype", F.substring("h", 1, 2).alias("kind"), F.substring("h", 3, 2).alias("first_byte"), F.substring("h", 15, 2).alias("last_byte")),
)
KEYS_SQL = """keys AS (SELECT DISTINCT CASE user_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'é' WHEN 2 THEN '中' ELSE '😀' END || CAST(user_id AS VARCHAR) || event_type AS k FROM events),
  numbered AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS n, hex(encode(k)) AS h, hex(encode(lag(k) OVER (ORDER BY k))) AS hp, lead(k) OVER (ORDER BY k) AS nxt, hex(encode(lead(k) OVER (ORDER BY k))) AS hn FROM keys)"""


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of one to four bytes a character."""
    first = F.expr("case user_id % 4 when 0 then '' when 1 then 'é' when 2 then '中' else '😀' end")
    return src.table(spark, sf_dir, "events").select(F.concat(first, F.col("user_id").cast("string"), "event_type").alias("k")).distinct()


def byte_sql(h: str, at: str) -> str:
    """The value of a byte of a hex string, counted from 0."""
    digit = lambda plus: f"(instr('0123456789ABCDEF', substr({h}, CAST(2 * ({at}) + {plus} AS BIGINT), 1)) - 1)"
    return f"(16 * {digit(1)} + {digit(2)})"


query("q42_shared_prefix_len", f"WITH {KEYS_SQL}, e AS (SELECT k, CASE WHEN n % 16 = 0 THEN 0 ELSE {LCP.format(a='h', b='hp')} END AS shared, h FROM numbered) SELECT k, shared, CAST(length(h) // 2 AS INT) - shared AS unshared FROM e")(
    lambda s, d: codec.block_entries(names(s, d)).select("k", "shared", "unshared")
)
query("q43_restart_points", f"WITH {KEYS_SQL} SELECT k, n % 16 = 0 AS restart FROM numbered")(lambda s, d: codec.block_entries(names(s, d)).select("k", "restart"))
query("q44_shortest_separator", f"""WITH {KEYS_SQL}, d AS (SELECT *, {LCP.format(a='h', b='hn')} AS d FROM numbered WHERE nxt IS NOT NULL)
  SELECT k, nxt, CASE WHEN d < least(length(h), length(hn)) // 2 AND {byte_sql('h', 'd')} + 1 < {byte_sql('hn', 'd')} THEN left(h, 2 * d) || printf('%02X', {byte_sql('h', 'd')} + 1) ELSE h END AS sep FROM d""")(
    lambda s, d: ordered(names(s, d)).where("nxt is not null").select("k", "nxt", F.hex(codec.separator("k", "nxt")).alias("sep"))
)
query("q44b_shortest_successor", f"WITH {KEYS_SQL} SELECT k, printf('%02X', {byte_sql('h', '0')} + 1) AS succ FROM numbered")(lambda s, d: names(s, d).withColumn("succ", F.hex(codec.successor("k"))))
query("q45_file_name_parse", f"WITH {PARSED} SELECT name, kind, CASE WHEN kind IN ('manifest', 'log', 'table', 'temp') THEN number END AS number FROM parsed")(lambda s, d: manifest.parse_names(listing(s, d)))
_WORD = "CAST(" + " + ".join(f"{byte_sql('h', f'4 * i + {j}')} * {256**j}" for j in range(4)) + " AS UBIGINT)"
_MIX = "((({x}) % 4294967296) * {m} % 4294967296)"


def _mixed(x: str, shift: int) -> str:
    y = _MIX.format(x=x, m=MULTIPLIER)
    return f"xor({y}, {y} // {2**shift})"


query("q45b_byte_hash", f"""WITH {KEYS_SQL}, w AS (SELECT k, h, CAST(length(h) // 2 AS UBIGINT) AS n, list_transform(generate_series(0, length(h) // 8 - 1), lambda i: {_WORD}) AS words FROM numbered),
  f AS (SELECT k, h, n, list_reduce(list_prepend(xor(CAST({SEED} AS UBIGINT), n * {MULTIPLIER} % 4294967296), words), lambda a, b: {_mixed('a + b', 16)}) AS g FROM w),
  t AS (SELECT k, n, g, CAST({" + ".join(f"CASE WHEN n % 4 > {j} THEN {byte_sql('h', f'n - n % 4 + {j}')} * {256**j} ELSE 0 END" for j in range(3))} AS UBIGINT) AS rest FROM f),
  r AS (SELECT k, CASE WHEN n % 4 = 0 THEN g ELSE {_mixed('g + rest', 24)} END AS h FROM t) SELECT k, CAST(h AS BIGINT) AS h, CAST(h // 268435456 AS INT) AS shard FROM r""")(
    lambda s, d: names(s, d).withColumn("h", codec.byte_hash("k")).withColumn("shard", codec.shard(F.col("h")))
)


_REMAINDERS = "SELECT list(list_reduce(list_prepend(CAST(b AS BIGINT), generate_series(1, 8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 2197175160) ELSE c >> 1 END) ORDER BY b) AS t FROM range(256) x(b)"
query("q45c_checksum", f"""WITH {KEYS_SQL}, r AS ({_REMAINDERS}), b AS (SELECT k, list_transform(generate_series(0, length(h) // 2 - 1), lambda i: CAST({byte_sql('h', 'i')} AS BIGINT)) AS bytes FROM numbered)
  SELECT k, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS crc FROM b, r""")(
    lambda s, d: names(s, d).withColumn("crc", checksum(F.col("k").cast("binary")))
)


@query("q46_bloom_no_false_negative", f"WITH {PLACED} SELECT number, count(DISTINCT k) AS present, 0::BIGINT AS missed, true AS few_others FROM placed GROUP BY number")
def q46(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's filter asked for its keys, which it may not miss, and for as many others, of which few may match."""
    keys = src.placed(spark, sf_dir).select("number", "k").distinct()
    others = keys.select("number", F.concat(F.lit("no such "), "k").alias("k"))
    found = codec.bloom_match(keys.union(others), codec.bloom_build(keys, "number"), "number").withColumn("own", ~F.col("k").startswith("no such "))
    hits = F.sum(F.when(~F.col("own") & F.col("may_match"), 1).otherwise(0))
    return found.groupBy("number").agg(F.sum(F.col("own").cast("long")).alias("present"), F.sum(F.when(F.col("own") & ~F.col("may_match"), 1).otherwise(0)).cast("long").alias("missed"), (hits <= 3 + F.count("*") / BITS_PER_KEY).alias("few_others"))


@query("q47_wal_replay_max_seq", f"WITH {BATCHES} SELECT batch_id // 100 AS log_number, max(base + ops - 1) AS max_seq, count(*) AS batches, CAST(sum(ops) AS BIGINT) AS ops FROM batches GROUP BY batch_id // 100")
def q47(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batches written to logs of 100, and what a restart finds in those."""
    logs = formats.write_logs(batch.collect(src.oplog(spark, sf_dir)).withColumn("log_number", F.expr("batch_id div 100")))
    return formats.replay(logs).groupBy("log_number").agg(F.max("seq").alias("max_seq"), F.count_distinct("base").alias("batches"), F.count("*").alias("ops"))


@query("q47b_wal_replay_state", f"WITH {NEWEST} SELECT k, seq, v FROM newest WHERE vtype = 1")
def q47b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after a restart from the logs alone."""
    logs = formats.write_logs(batch.collect(src.oplog(spark, sf_dir)).withColumn("log_number", F.expr("batch_id div 100")))
    return resolve.latest(formats.replay(logs)).select("k", "seq", "v")


@query("q48_stream_latest", f"WITH {NEWEST} SELECT k, seq, v FROM newest WHERE vtype = 1")
def q48(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log streamed into a store batch by batch, then read."""
    store = Store.open(spark, paths.new_path(spark, "store"), Options(create_if_missing=True))
    events = ingest.read_ops(spark, sf_dir, "events.parquet", src.table(spark, sf_dir, "events").schema)
    ops = events.select(F.lpad(F.col("user_id").cast("string"), 6, "0").alias("k"), (F.col("event_id") + 1).alias("seq"), F.when(F.col("event_type") != "error", F.col("props")).alias("v"))
    ingest.ingest(ops, store, paths.new_path(spark, "stream"), "events")
    return store.scan().select("k", "seq", "v")


@query("q49_store_compacted", f"WITH {NEWEST} SELECT k, seq, v FROM newest WHERE vtype = 1 AND k >= '{LOW}'")
def q49(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four writes into a store, merged into level 1, then a range scan."""
    store = Store.open(spark, paths.new_path(spark, "store"), Options(create_if_missing=True, auto_compact=False))
    log = src.oplog(spark, sf_dir)
    first, last = log.agg(F.coalesce(F.min("seq"), F.lit(1)), F.coalesce(F.max("seq"), F.lit(0))).first()
    cuts = [first - 1 + (last - first + 1) * i // 4 for i in range(5)]
    for low, high in zip(cuts, cuts[1:], strict=False):
        part = log.where(f"seq > {low} and seq <= {high}").select("k", "v", (F.col("seq") - 1 - store.last_seq).alias("pos"))
        store.write_frame(part, "pos")
    store.compact_range()
    return store.scan(low=LOW).select("k", "seq", "v")


simple("q50_orders_kv", "SELECT lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS k, o_orderkey + 1 AS seq, 1 AS vtype, o_orderpriority AS v FROM orders", resolve.scan, src.orders_kv)

# table files and edits, byte by byte

query("q51_table_files", f"WITH {PLACED} SELECT number, k, seq, vtype, v FROM placed")(lambda s, d: formats.scan_tables(formats.write_tables(src.placed(s, d))))
query("q51b_table_seek", f"WITH {PLACED} SELECT number, k, seq, vtype, v FROM placed WHERE k >= '{SEEK}'")(lambda s, d: formats.scan_tables(formats.write_tables(src.placed(s, d)), SEEK))
query("q52_table_point_get", f"WITH {PLACED} SELECT number, k, seq, vtype, v FROM placed WHERE k = '{KEY}' AND seq <= {SNAP} QUALIFY row_number() OVER (PARTITION BY number ORDER BY seq DESC) = 1")(
    lambda s, d: formats.get_from_tables(formats.write_tables(src.placed(s, d)), KEY, SNAP)
)
query("q53_edit_codec", f"WITH {EDITS} SELECT edit_id, is_add, level, number, CASE WHEN is_add = 1 THEN size END AS size, CASE WHEN is_add = 1 THEN smallest END AS smallest, CASE WHEN is_add = 1 THEN largest END AS largest FROM edits JOIN files USING (level, number)")(
    lambda s, d: formats.read_edits(formats.write_edits(src.edits(s, d), src.files(s, d)))
)


@query("q54_compaction_to_rest", f"WITH {NEWEST} SELECT k, seq, v, true AS at_rest FROM newest WHERE vtype = 1")
def q54(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six writes into a store with small levels, then compactions as they are picked until none is needed."""
    store = Store.open(spark, paths.new_path(spark, "store"), Options(create_if_missing=True, auto_compact=False, file_bytes=1 << 20, level1=2 << 20))
    log = src.oplog(spark, sf_dir)
    first, last = log.agg(F.coalesce(F.min("seq"), F.lit(1)), F.coalesce(F.max("seq"), F.lit(0))).first()
    cuts = [first - 1 + (last - first + 1) * i // 6 for i in range(7)]
    for low, high in zip(cuts, cuts[1:], strict=False):
        store.write_frame(log.where(f"seq > {low} and seq <= {high}").select("k", "v", (F.col("seq") - 1 - store.last_seq).alias("pos")), "pos")
    store.maintain()
    return store.scan().select("k", "seq", "v", F.lit(store.next_compaction() is None).alias("at_rest"))
