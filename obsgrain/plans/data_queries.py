"""Queries of curation, segment, frame, classification and source operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obsgrain.functions import scalars
from obsgrain.operators import classify, extract, frames, info, kernels, segments, select
from obsgrain.operators import stats as stats_ops
from obsgrain.operators.cuts import scratch
from obsgrain.operators.ranks import ranked
from obsgrain.plans.registry import query, rounded
from obsgrain.plans.tables import SEG, obs_d, read, seg, signals
from obsgrain.sources import readers, writers

_SEL = "sel AS (SELECT source AS entity, lang AS stratum, doc_id AS obs_id, n_chars AS duration FROM documents)"


def sel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("source").alias("entity"), F.col("lang").alias("stratum"), F.col("doc_id").alias("obs_id"), F.col("n_chars").alias("duration"))


@query(
    f"WITH {_SEL}, k AS (SELECT * FROM sel WHERE duration >= 400), q AS (SELECT * FROM k WHERE entity IN (SELECT entity FROM k GROUP BY 1 HAVING count(*) >= 5)), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('0:' || entity), entity) AS k FROM (SELECT DISTINCT stratum, entity FROM q)), "
    "c AS (SELECT q.*, row_number() OVER (PARTITION BY q.stratum, q.entity ORDER BY obs_id) AS m FROM q JOIN o ON q.stratum = o.stratum AND q.entity = o.entity WHERE o.k <= 4) SELECT entity, stratum, obs_id, duration FROM c WHERE m <= 5"
)
def select_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.select_entities(sel(spark, sf_dir), 4, 5, 400).select("entity", "stratum", "obs_id", "duration")


@query(f"WITH {_SEL} SELECT entity, obs_id FROM sel WHERE duration >= 2000 AND entity IN (SELECT entity FROM sel WHERE duration >= 2000 GROUP BY 1 HAVING count(*) >= 10)")
def having_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.having(sel(spark, sf_dir), "entity", "duration >= 2000", 10).select("entity", "obs_id")


@query(f"WITH {_SEL}, p AS (SELECT stratum, entity, count(*) AS n FROM sel GROUP BY ALL) SELECT stratum, count(*)::BIGINT AS entities, min(n)::BIGINT AS least, max(n)::BIGINT AS most, bool_and(n >= 5) AS all_enough, count(*) >= 10 AS available FROM p GROUP BY 1")
def availability_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.availability(sel(spark, sf_dir), 10, 5)


@query("SELECT row_number() OVER (ORDER BY regexp_extract(s, '^([^0-9]*)', 1), coalesce(try_cast(regexp_extract(s, '([0-9]+)', 1) AS BIGINT), -1), coalesce(try_cast(regexp_extract(s, '[0-9]+[^0-9]+([0-9]+)', 1) AS BIGINT), -1), s)::BIGINT AS k, s AS source FROM (SELECT DISTINCT source AS s FROM documents)")
def natural_key_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("source").distinct()
    return d.select(F.row_number().over(Window.orderBy(*scalars.natural_key(F.col("source")))).cast("long").alias("k"), "source")


@query("WITH p AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'), r AS (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'), n AS (SELECT count(*) AS n FROM p) SELECT c_custkey FROM p UNION ALL SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS k FROM r), n WHERE k <= greatest(500 - n, 0)")
def fill_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return select.fill_limit(c.where("c_mktsegment = 'BUILDING'").select("c_custkey"), c.where("c_mktsegment <> 'BUILDING'").select("c_custkey"), 500, ["c_custkey"])


@query(
    "WITH o AS (SELECT l_partkey AS k, 'return' AS v, 1 AS p FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_partkey, 'air', 2 FROM lineitem WHERE l_linestatus = 'F' AND l_quantity > 40), b AS (SELECT k, first(v ORDER BY p) AS v FROM o GROUP BY 1) SELECT p_partkey, coalesce(v, 'UNRESOLVED') AS release FROM part LEFT JOIN b ON p_partkey = k"
)
def priority_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    one = li.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"), F.lit("return").alias("release"), F.lit(1).alias("p"))
    two = li.where("l_linestatus = 'F' and l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"), F.lit("air").alias("release"), F.lit(2).alias("p"))
    return select.priority_resolve(read(spark, sf_dir, "part").select("p_partkey"), one.unionByName(two), "p_partkey", "release", "p", "UNRESOLVED").select("p_partkey", "release")


@query("SELECT doc_id, quality::BIGINT AS quality, toxic::BIGINT AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def left_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels").dropDuplicates(["doc_id"]), "doc_id", "left").select("doc_id", "quality", "toxic"))


@query("SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def lookup_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", "n_name", "r_name")
    return read(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "n_name", "r_name")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.remaining(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels").select("doc_id"), "doc_id")


_NOW = "now AS (SELECT doc_id, CASE WHEN n_chars > 1500 THEN 1 WHEN n_chars > 100 THEN 0 END AS q FROM documents)"


def _now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") > 1500, 1).when(F.col("n_chars") > 100, 0).alias("quality"))


@query(f"WITH {_NOW} SELECT count_if(q = quality)::BIGINT AS agree, count_if(q <> quality)::BIGINT AS drift, count_if(q IS NULL)::BIGINT AS missing FROM labels LEFT JOIN now USING (doc_id)")
def drift_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.drift(_now(spark, sf_dir), read(spark, sf_dir, "labels"), "doc_id", "quality")


@query(f"WITH {_NOW} SELECT doc_id, quality::BIGINT AS was, q::BIGINT AS now FROM labels LEFT JOIN now USING (doc_id) WHERE q IS NULL OR q <> quality ORDER BY doc_id LIMIT 10")
def drift_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's ten examples."""
    return rounded(select.drift_examples(_now(spark, sf_dir), read(spark, sf_dir, "labels"), "doc_id", "quality"))


@query("SELECT count(*) = 0 AS is_subset, count(*) AS n_outside FROM (SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem)")
def subset_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every part was sold."""
    return select.subset(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k")))


@query("SELECT o_orderkey, o_orderpriority, round(o_totalprice, 2) AS o_totalprice FROM orders ORDER BY o_orderpriority ASC NULLS LAST, o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25")
def mixed_order_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 orders by priority ascending, then price descending."""
    d = select.top(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), 25, [("o_orderpriority", True), ("o_totalprice", False), ("o_orderkey", True)])
    return rounded(d, 2)


@query("WITH a AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49), b AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_discount = 0 AND l_tax = 0) SELECT 'both' AS what, count(*)::BIGINT AS n FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'first', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'either', count(*) FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'all', count(*) FROM (SELECT k FROM a UNION ALL SELECT k FROM b)")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    a = li.where("l_returnflag = 'R' and l_quantity > 49").select(F.col("l_suppkey").alias("k")).distinct()
    b = li.where("l_discount = 0 and l_tax = 0").select(F.col("l_suppkey").alias("k")).distinct()
    out = None
    for what, d in (("both", a.intersect(b)), ("first", a.subtract(b)), ("either", a.union(b).distinct()), ("all", a.unionAll(b))):
        one = d.agg(F.lit(what).alias("what"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


_VOTES = "v AS (SELECT user_id AS entity, (event_id * 37 % 101) / 100.0::DOUBLE AS pa FROM events), g AS (SELECT entity, count_if(pa > 1 - pa) AS na, count_if(pa <= 1 - pa) AS nb, coalesce(sum(CASE WHEN pa > 1 - pa THEN pa END), 0) AS ca, coalesce(sum(CASE WHEN pa <= 1 - pa THEN 1 - pa END), 0) AS cb FROM v GROUP BY 1), d AS (SELECT *, CASE WHEN na = nb THEN 'tie' WHEN greatest(na, nb) >= (na + nb) * 0.6 THEN 'tagged' ELSE 'ambiguous' END AS decision FROM g)"


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pa = (F.col("event_id") * 37 % 101).cast("double") / F.lit(100.0)
    return select.votes(read(spark, sf_dir, "events").select(F.col("user_id").alias("entity"), pa.alias("pa"), (1 - pa).alias("pb")), tagged=0.6)


@query(f"WITH {_VOTES} SELECT entity, na::BIGINT AS n_a, nb::BIGINT AS n_b, CASE WHEN na = nb THEN 'tie' WHEN na > nb THEN 'a' ELSE 'b' END AS majority, greatest(na, nb)::BIGINT AS majority_count, round(CASE WHEN na > nb THEN ca - cb ELSE cb - ca END / (na + nb), 6) AS avg_conf, decision FROM d")
def vote_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_votes(spark, sf_dir))


@query(f"WITH {_VOTES} SELECT decision, count(*)::BIGINT AS n FROM d GROUP BY 1")
def decision_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.tally(_votes(spark, sf_dir))


@query(
    f"WITH {_VOTES}, r AS (SELECT entity, decision, greatest(na, nb) AS m, CASE WHEN na > nb THEN ca - cb ELSE cb - ca END / (na + nb) AS c FROM d) SELECT 'ambiguous' AS list, row_number() OVER (ORDER BY m DESC, c DESC NULLS LAST, entity) AS place, entity FROM r WHERE decision = 'ambiguous' UNION ALL SELECT 'tie', row_number() OVER (ORDER BY c DESC NULLS LAST, entity), entity FROM r WHERE decision = 'tie'"
)
def decision_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undecided entities in the order in which they are to be looked at."""
    ambiguous, ties = select.split_decisions(_votes(spark, sf_dir))
    keys = {"ambiguous": [F.desc("majority_count"), F.desc_nulls_last("avg_conf"), "entity"], "tie": [F.desc_nulls_last("avg_conf"), "entity"]}
    out = [ranked(d, keys[name], (), "place").select(F.lit(name).alias("list"), "place", "entity") for name, d in (("ambiguous", ambiguous), ("tie", ties))]
    return out[0].unionByName(out[1])


@query("WITH m AS (SELECT l_orderkey AS k, avg(l_quantity) / 1000 AS v FROM lineitem WHERE l_quantity BETWEEN 3 AND 30 GROUP BY 1) SELECT o_orderkey, round(v, 6) AS value FROM orders LEFT JOIN m ON o_orderkey = k")
def usable_mean_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").alias("value"))
    return rounded(select.usable_mean(read(spark, sf_dir, "orders").select("o_orderkey"), li, "o_orderkey", "value", 3, 30, 1 / 1000), 6)


@query("SELECT l_returnflag, count(l_extendedprice)::BIGINT AS n, round(median(l_extendedprice), 4) AS median, round(quantile_cont(l_extendedprice, 0.25), 4) AS q25, round(quantile_cont(l_extendedprice, 0.75), 4) AS q75, round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY 1")
def iqr_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(select.spread(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice"), 4)


@query("SELECT round(quantile_cont(o_totalprice, 0.05), 4) AS p5, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.95), 4) AS p95, round(avg(o_totalprice), 4) AS mean FROM orders")
def percentile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(select.percentiles(read(spark, sf_dir, "orders"), "o_totalprice"), 4)


@query("SELECT l_suppkey, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS mean, round(100 * avg((l_quantity < 10)::INT), 6) AS pct_small FROM lineitem GROUP BY 1")
def weighted_mean_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(stats_ops.weighted_mean(F.col("l_discount"), F.col("l_quantity")).alias("mean"), select.pct(F.col("l_quantity") < 10).alias("pct_small"))
    return rounded(d)


@query("SELECT n_regionkey::BIGINT AS n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def sorted_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(select.joined_names(read(spark, sf_dir, "nation"), "n_regionkey", "n_name"))


@query("SELECT p_partkey, ((row_number() OVER (ORDER BY p_partkey) - 1) % 7)::BIGINT AS shard FROM part")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.shards(read(spark, sf_dir, "part").select("p_partkey"), 7, ["p_partkey"])


@query("WITH k AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS k FROM customer) SELECT c_custkey, (k // 100 + 1)::BIGINT AS folder, (k % 100 + 1)::BIGINT AS place, printf('%s%03d_%02d', c_mktsegment, k // 100 + 1, k % 100 + 1) AS name FROM k")
def group_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.group_ordinals(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", ["c_custkey"]).select("c_custkey", "folder", "place", "name")


@query("SELECT o_custkey, first(o_orderpriority ORDER BY o_orderkey) AS priority FROM orders GROUP BY 1")
def first_in_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("priority"), "o_orderkey")
    return select.first_in_group(d, "o_custkey", "priority", "o_orderkey")


@query("SELECT lang, count_if(labels.doc_id IS NOT NULL)::BIGINT AS present, count_if(labels.doc_id IS NULL)::BIGINT AS missing FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def presence_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.presence(read(spark, sf_dir, "documents").select("doc_id", "lang"), read(spark, sf_dir, "labels"), "doc_id", "lang")


@query("SELECT CASE lower(trim(c_mktsegment)) WHEN 'building' THEN 'house' WHEN 'furniture' THEN 'house' WHEN 'automobile' THEN 'car' ELSE 'other' END AS kind, count(*)::BIGINT AS n FROM customer GROUP BY 1")
def category_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").groupBy(scalars.category(F.col("c_mktsegment"), {"house": ["building", "furniture"], "car": ["automobile"]}, "other").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s_suppkey, substr(sha256(s_name), 1, 16) AS hash FROM supplier")
def config_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select("s_suppkey", scalars.short_hash(F.col("s_name")).alias("hash"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k, CASE WHEN max(value) OVER () > 1000 THEN value / 1000 ELSE value END AS seconds FROM events")
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k double")["k"].alias("k"), F.col("value").alias("seconds"))
    return scalars.rescale_seconds(d, "seconds").select("event_id", "k", "seconds")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, extract(hour FROM ts)::BIGINT AS hour, count(*) AS n, min(epoch_us(ts)) // 1000000 AS first_second FROM events GROUP BY ALL")
def event_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and hour, in UTC."""
    d = read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    return rounded(d.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.unix_seconds(F.min("ts")).alias("first_second")))


_SILENT = ["assistant"]
_RUNS = "r AS (SELECT *, sum((label = 'assistant')::INT) OVER (PARTITION BY utt_id ORDER BY seq) AS run FROM seg), g AS (SELECT utt_id, run, max(\"end\") - min(start) AS len FROM r WHERE label <> 'assistant' GROUP BY ALL)"


@query(f"WITH {SEG}, {_RUNS} SELECT u.utt_id, round(avg(len), 6) AS mean_length, count(len)::BIGINT AS n FROM (SELECT DISTINCT utt_id FROM seg) u LEFT JOIN g ON u.utt_id = g.utt_id GROUP BY 1")
def run_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(segments.run_lengths(seg(spark, sf_dir), _SILENT))


@query(f"WITH {SEG}, p AS (SELECT *, lag(label) OVER (PARTITION BY utt_id ORDER BY seq) AS b FROM seg) SELECT utt_id, round(avg(CASE WHEN label = 'assistant' AND b = 'user' THEN \"end\" - start END), 6) AS mean_length, count_if(label = 'assistant' AND coalesce(b = 'user', false))::BIGINT AS n FROM p GROUP BY 1")
def predecessor_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(segments.preceded(seg(spark, sf_dir), ["assistant"], ["user"]))


@query(f"WITH {SEG} SELECT utt_id, round(count_if(label = 'user') * 1000.0::DOUBLE / nullif(max(CASE WHEN label <> 'system' THEN \"end\" END) - min(CASE WHEN label <> 'system' THEN start END), 0), 6) AS rate, count_if(label = 'user')::BIGINT AS n FROM seg GROUP BY 1")
def speech_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(segments.rate(seg(spark, sf_dir), ["user"], ["system"], 1000.0))


@query(
    f"WITH {SEG}, t AS (SELECT utt_id, greatest(floor((max(\"end\") - 400) / 160.0) + 1, 0)::BIGINT AS n FROM seg GROUP BY 1), f AS (SELECT utt_id, unnest(range(n)) AS frame FROM t) "
    "SELECT f.utt_id, f.frame, f.frame * 160 + 200 AS center, label FROM f JOIN seg ON f.utt_id = seg.utt_id AND f.frame * 160 + 200 >= start AND f.frame * 160 + 200 < \"end\""
)
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.frames_of(seg(spark, sf_dir))


@query(f"WITH {SEG}, p AS (SELECT utt_id, seq, start + 150 AS \"at\" FROM seg) SELECT p.utt_id, p.seq, p.\"at\", coalesce(s.label, '') AS label FROM p LEFT JOIN seg s ON s.utt_id = p.utt_id AND p.\"at\" >= s.start AND p.\"at\" < s.\"end\"")
def interval_join_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label at 150 characters after the start of each turn."""
    s = seg(spark, sf_dir)
    return rounded(segments.interval_join(s.select("utt_id", "seq", (F.col("start") + 150).alias("at")), s))


@query(f"WITH {SEG} SELECT utt_id, count(*) AS n, string_agg(label || ':' || start::VARCHAR || '-' || \"end\"::VARCHAR, ',' ORDER BY start, \"end\", label) AS said FROM seg GROUP BY 1")
def segment_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each utterance's segments as one ordered list."""
    d = segments.segment_lists(seg(spark, sf_dir))
    said = F.array_join(F.transform("segments", lambda x: F.concat(x["label"], F.lit(":"), x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), ",")
    return d.select("utt_id", F.size("segments").cast("long").alias("n"), said.alias("said"))


@query(f"WITH {SEG}, t AS (SELECT utt_id, max(\"end\") AS total FROM seg GROUP BY 1) SELECT utt_id, seq, label, greatest(start - 50.0, 0)::DOUBLE AS low, least(\"end\" + 300.0, total)::DOUBLE AS high FROM seg JOIN t USING (utt_id)")
def cut_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments widened by 50 before and 300 after, as an adapter to an external model takes them."""
    return segments.windows(seg(spark, sf_dir), 50.0, 300.0)


@query(
    f"WITH {SEG}, {_RUNS}, a AS (SELECT utt_id, round(count_if(label = 'user') * 1000.0::DOUBLE / nullif(max(CASE WHEN label <> 'assistant' THEN \"end\" END) - min(CASE WHEN label <> 'assistant' THEN start END), 0), 6) AS rate, count_if(label = 'user') AS n_rate FROM seg GROUP BY 1), "
    "p AS (SELECT *, lag(label) OVER (PARTITION BY utt_id ORDER BY seq) AS b FROM seg), b AS (SELECT utt_id, round(avg(CASE WHEN label = 'assistant' AND b = 'user' THEN \"end\" - start END), 6) AS stop, count_if(label = 'assistant' AND coalesce(b = 'user', false)) AS n_stop FROM p GROUP BY 1), "
    "c AS (SELECT utt_id, round(avg(len), 6) AS run, count(len) AS n_run FROM g GROUP BY 1) SELECT a.utt_id, rate, n_rate::BIGINT AS n_rate, stop, n_stop::BIGINT AS n_stop, run, coalesce(n_run, 0)::BIGINT AS n_run FROM a JOIN b USING (utt_id) LEFT JOIN c USING (utt_id)"
)
def timing_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate, stops and runs of each utterance joined."""
    return rounded(segments.timing(seg(spark, sf_dir), ["user"], ["assistant"], ["user"], _SILENT, 1000.0))


@query("SELECT event_id, lead(event_id) OVER w AS next_id, round(lead(value) OVER w - value, 6) AS step FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id) QUALIFY next_id IS NOT NULL")
def consecutive_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event and its user's next."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    d = read(spark, sf_dir, "events").select("event_id", F.lead("event_id").over(w).alias("next_id"), (F.lead("value").over(w) - F.col("value")).alias("step"))
    return rounded(d.where("next_id is not null"))


@query(f"WITH {SEG}, p AS (SELECT utt_id, seq, start + 100 AS \"at\" FROM seg WHERE label = 'user') SELECT p.utt_id, seq, p.\"at\", (EXISTS (SELECT 1 FROM seg s WHERE s.utt_id = p.utt_id AND s.label = 'assistant' AND p.\"at\" >= s.start AND p.\"at\" < s.\"end\"))::BIGINT AS inside FROM p")
def interval_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = seg(spark, sf_dir)
    return rounded(segments.in_any(s.where("label = 'user'").select("utt_id", "seq", (F.col("start") + 100).alias("at")), s.where("label = 'assistant'").select("utt_id", "start", "end")))


@query(
    "WITH p AS (SELECT user_id AS utt_id, epoch_us(ts) / 1000000.0::DOUBLE AS at FROM events WHERE event_id % 3 = 0), s AS (SELECT user_id AS utt_id, epoch_us(ts) / 1000000.0::DOUBLE AS at, max(value) AS value FROM events WHERE event_id % 3 <> 0 GROUP BY ALL) "
    "SELECT p.utt_id, p.at, round(first(s.value ORDER BY abs(s.at - p.at), s.at DESC), 6) AS value FROM (SELECT DISTINCT * FROM p) p LEFT JOIN s ON p.utt_id = s.utt_id GROUP BY ALL"
)
def nearest_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("utt_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("at"), "value")
    samples = e.where("event_id % 3 <> 0").groupBy("utt_id", "at").agg(F.max("value").alias("value"))
    return rounded(segments.nearest(e.where("event_id % 3 = 0").select("utt_id", "at").distinct(), samples))


_SIG = "sig AS (SELECT vec_id AS utt_id, embedding::DOUBLE[] AS x FROM embeddings)"
_FR = f"{_SIG}, fr AS (SELECT utt_id, f AS frame, x[f * 8 + 1:f * 8 + 16] AS w FROM sig CROSS JOIN (SELECT unnest(range(7)) AS f)), sm AS (SELECT utt_id, frame, i, w[i] AS v, (i - 1) * 500.0::DOUBLE AS hz FROM fr CROSS JOIN (SELECT unnest(range(1, 17)) AS i))"


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 16 samples every 8; squares stand for power at multiples of 500 Hz."""
    d = frames.framed(signals(spark, sf_dir).select("utt_id", "samples"), 16, 8)
    return d.select("utt_id", "frame", "samples", F.transform("samples", lambda x: x * x).alias("power"), F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: i * 500.0).alias("freqs"))


@query(f"WITH {_FR} SELECT utt_id, frame, round(sqrt(avg(v * v)), 6) AS rms FROM sm GROUP BY ALL")
def frame_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_frames(spark, sf_dir).select("utt_id", "frame", frames.rms(F.col("samples")).alias("rms")))


@query(f"WITH {_SIG}, s AS (SELECT utt_id, i, x[i] AS v, x[i - 1] AS b FROM sig CROSS JOIN (SELECT unnest(range(1, 65)) AS i)) SELECT utt_id, round(sum(abs(CASE WHEN i = 1 THEN v ELSE v - 0.97 * b END)), 6) AS total FROM s GROUP BY 1")
def pre_emphasis(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = frames.pre_emphasis(F.col("samples"))
    return rounded(signals(spark, sf_dir).select("utt_id", frames.total(F.transform(y, F.abs)).alias("total")))


@query(
    f"WITH {_FR}, p AS (SELECT *, v * v / (sum(v * v) OVER w + 1e-12) AS q FROM sm WINDOW w AS (PARTITION BY utt_id, frame)), m AS (SELECT utt_id, frame, sum(q * hz) AS mu FROM p GROUP BY ALL), c AS (SELECT utt_id, frame, any_value(mu) AS mu, sqrt(sum(q * (hz - mu) ** 2)) AS sd, sum(q * (hz - mu) ** 3) AS m3, sum(q * (hz - mu) ** 4) AS m4 FROM p JOIN m USING (utt_id, frame) GROUP BY ALL) "
    "SELECT utt_id, frame, round(mu, 4) AS centroid, round(sd, 4) AS sd, round(m3 / (sd + 1e-12) ** 3, 4) AS skewness, round(m4 / (sd + 1e-12) ** 4, 4) AS kurtosis FROM c"
)
def spectral_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = frames.moments(F.col("power"), F.col("freqs"))
    return rounded(_frames(spark, sf_dir).select("utt_id", "frame", *[v.alias(k) for k, v in m.items()]), 4)


@query(f"WITH {_FR}, p AS (SELECT *, v * v / (sum(v * v) OVER (PARTITION BY utt_id, frame) + 1e-12) AS q FROM sm) SELECT utt_id, frame, round(-sum(q * ln(q + 1e-12)), 6) AS entropy FROM p GROUP BY ALL")
def spectral_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_frames(spark, sf_dir).select("utt_id", "frame", frames.entropy(F.col("power")).alias("entropy")))


@query(f"WITH {_FR}, c AS (SELECT *, sum(v * v) OVER (PARTITION BY utt_id, frame ORDER BY i) AS run, 0.85 * sum(v * v) OVER (PARTITION BY utt_id, frame) AS aim FROM sm) SELECT utt_id, frame, min(hz) AS rolloff FROM c WHERE run >= aim GROUP BY ALL")
def rolloff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir).select("utt_id", "frame", frames.rolloff(F.col("power"), F.col("freqs")).alias("rolloff"))


@query(f"WITH {_FR} SELECT utt_id, frame, round(sum(CASE WHEN hz >= 1000 AND hz < 5000 THEN v * v ELSE 0 END) / (sum(CASE WHEN hz >= 50 AND hz < 1000 THEN v * v ELSE 0 END) + 1e-12), 4) AS alpha, first(hz ORDER BY v * v DESC, hz) FILTER (hz >= 2000) AS peak FROM sm GROUP BY ALL")
def band_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, f = F.col("power"), F.col("freqs")
    return rounded(_frames(spark, sf_dir).select("utt_id", "frame", frames.ratio(frames.band(p, f, 1000, 5000), frames.band(p, f, 50, 1000)).alias("alpha"), frames.peak(p, f, 2000).alias("peak")), 4)


@query(f"WITH {_FR}, l AS (SELECT utt_id, frame, i, abs(v) AS a, lag(abs(v)) OVER (PARTITION BY utt_id, i ORDER BY frame) AS b FROM sm) SELECT utt_id, frame, round(sqrt(sum((a - b) ** 2)), 6) AS flux FROM l GROUP BY ALL")
def flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_frames(spark, sf_dir).select("utt_id", "frame", frames.flux().alias("flux")))


@query("SELECT event_id, round(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id)), 6) AS delta FROM events")
def lag_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("utt_id"), F.col("event_id").alias("frame"), "value")
    return rounded(d.select("event_id", frames.delta(d, "value").alias("delta")))


@query(f"WITH {_FR} SELECT utt_id, frame, round(10 * log10(max(CASE WHEN hz BETWEEN 1600 AND 2400 THEN v * v END) + 1e-12) - 10 * log10(max(CASE WHEN hz BETWEEN 200 AND 500 THEN v * v END) + 1e-12), 4) AS nasality FROM sm GROUP BY ALL")
def nasality(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, f, first = F.col("power"), F.col("freqs"), F.lit(2000.0)
    return rounded(_frames(spark, sf_dir).select("utt_id", "frame", (frames.peak_db(p, f, 0.8 * first, 1.2 * first) - frames.peak_db(p, f, F.lit(200.0), F.lit(500.0))).alias("nasality")), 4)


@query("SELECT l_orderkey, count(CASE WHEN l_returnflag <> 'N' THEN 1 END)::BIGINT AS n, round(CASE WHEN count_if(l_returnflag <> 'N') >= 5 THEN avg(l_quantity) FILTER (l_returnflag <> 'N') END, 6) AS mean, round(CASE WHEN count_if(l_returnflag <> 'N') >= 5 THEN median(l_quantity) FILTER (l_returnflag <> 'N') END, 6) AS median FROM lineitem GROUP BY 1")
def domain_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = F.col("l_returnflag") != "N"
    mean, n = frames.guarded(F.col("l_quantity"), "mean", mask)
    median, _ = frames.guarded(F.col("l_quantity"), "median", mask)
    return rounded(read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(n.alias("n"), mean.alias("mean"), median.alias("median")))


@query("SELECT user_id, round(stddev_samp(12 * log2(CASE WHEN value > 0 THEN value END)), 6) AS sd FROM events GROUP BY 1 HAVING count(value) >= 5 UNION ALL SELECT user_id, NULL FROM events GROUP BY 1 HAVING count(value) < 5")
def semitone_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    sd, _ = frames.guarded(F.col("value"), "sd_semitone")
    return rounded(read(spark, sf_dir, "events").groupBy("user_id").agg(sd.alias("sd")))


@query("WITH p AS (SELECT label::VARCHAR AS label, ((vec_id * 7) % 10)::VARCHAR AS predicted, (0.05 + (vec_id % 10) / 20.0)::DOUBLE AS q FROM embeddings), a AS (SELECT avg((label = predicted)::INT) AS acc, avg(log2(q)) AS lq, count(DISTINCT label) AS s FROM p) SELECT round(acc, 6) AS acc, round(log2(s) - (CASE WHEN acc > 0 AND acc < 1 THEN -(1 - acc) * log2(1 - acc) - acc * log2(acc) ELSE 0 END) - (1 - acc) * log2(s - 1), 6) AS i_fano, round(log2(s) + lq, 6) AS i_xent, s FROM a")
def fano_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("label"), (F.col("vec_id") * 7 % 10).cast("string").alias("predicted"), (0.05 + (F.col("vec_id") % 10) / 20.0).alias("q_true"))
    return rounded(info.fano_bounds(e))


@query(None)
def fano_classifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out logistic regression and discriminant analysis of languages by letter frequencies."""
    obs = obs_d(spark, sf_dir).withColumn("entity", F.substring("entity", 1, 2))
    return classify.summary(classify.run_folds(obs, 5, ("logreg", "lda"), hurdle="z"), 4)


@query(None)
def fano_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = obs_d(spark, sf_dir).withColumn("entity", F.substring("entity", 1, 2))
    return classify.summary(classify.run_folds(obs, 5, ("logreg",), shuffled=True), 4)


@query(None)
def fano_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = obs_d(spark, sf_dir).withColumn("entity", F.substring("entity", 1, 2))
    return classify.headline(classify.summary(classify.run_folds(obs, 3, ("mlp",)), 4))


_DFT = (
    f"{_SIG}, em AS (SELECT utt_id, i, x[i] AS raw, x[i] - CASE WHEN i = 1 THEN 0 ELSE 0.97::DOUBLE * x[i - 1] END AS v FROM sig CROSS JOIN (SELECT unnest(range(1, 65)) AS i)), "
    "fw AS (SELECT utt_id, f AS frame, i - f * 8 - 1 AS n, raw, v * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * (i - f * 8 - 1) / 16)) AS v FROM em JOIN (SELECT unnest(range(7)) AS f) t ON i > f * 8 AND i <= f * 8 + 16), "
    "dft AS (SELECT utt_id, frame, k, k * 1000.0::DOUBLE AS hz, sum(v * cos(2 * pi() * k * n / 16)) ** 2 + sum(v * sin(2 * pi() * k * n / 16)) ** 2 AS p FROM fw CROSS JOIN (SELECT unnest(range(9)) AS k) GROUP BY ALL), "
    "q AS (SELECT *, p / (sum(p) OVER w + 1e-12) AS q, sum(p) OVER (PARTITION BY utt_id, frame ORDER BY k) AS run, sum(p) OVER w AS total, sqrt(p) - lag(sqrt(p)) OVER (PARTITION BY utt_id, k ORDER BY frame) AS step FROM dft WINDOW w AS (PARTITION BY utt_id, frame)), "
    "mu AS (SELECT utt_id, frame, sum(q * hz) AS mu FROM q GROUP BY ALL), sd AS (SELECT utt_id, frame, any_value(mu) AS mu, sqrt(sum(q * (hz - mu) ** 2)) + 1e-12 AS sd FROM q JOIN mu USING (utt_id, frame) GROUP BY ALL), "
    "rms AS (SELECT utt_id, frame, sqrt(avg(raw * raw)) AS rms FROM fw GROUP BY ALL)"
)


@query(
    f"WITH {_DFT} SELECT utt_id, frame, round(sum(q * (hz - mu) ** 3) / any_value(sd) ** 3, 4) AS spectral_skewness, round(sum(q * (hz - mu) ** 4) / any_value(sd) ** 4, 4) AS spectral_kurtosis, round(-sum(q * ln(q + 1e-12)), 4) AS spectral_entropy, min(hz) FILTER (run >= 0.85 * total) AS spectral_rolloff, round(sqrt(sum(step * step)), 4) AS spectral_flux, round(any_value(rms), 4) AS \"RMS\" "
    "FROM q JOIN sd USING (utt_id, frame) JOIN rms USING (utt_id, frame) GROUP BY ALL"
)
def spectral_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spectral features of frames of 16 samples every 8."""
    names = ["spectral_skewness", "spectral_kurtosis", "spectral_entropy", "spectral_rolloff", "spectral_flux", "RMS"]

    def kernel(x):
        s = kernels.spectral(x, 16000, 16, 8)
        return [{"frame": k, **{n: float(s[n][k]) if s[n][k] == s[n][k] else None for n in names}} for k in range(len(s["RMS"]))]

    return rounded(kernels.apply(signals(spark, sf_dir), kernel, "frame long, " + ", ".join(f"{n} double" for n in names)).drop("error"), 4)


@query(None)
def burg_poles(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(x):
        return [{"freq": f, "width": b} for f, b in kernels.poles(kernels.burg(x, 8))]

    return kernels.apply(signals(spark, sf_dir), kernel, "freq double, width double")


@query(None)
def glottal_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(x):
        return [kernels.glottal_cycle(kernels.glottal_flow(x, 16000, 8, 4))]

    return kernels.apply(signals(spark, sf_dir), kernel, "GCT double, CQ double, NAQ double, MFDR double, SQ double")


@query(None)
def pitch_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(x):
        import numpy as np

        f = kernels.pitch(np.tile(x, 16), "F", 16000)
        return [{"frames": len(f), "voiced": int(np.isfinite(f).sum()), "f0": float(np.nanmedian(f)) if np.isfinite(f).any() else None}]

    return kernels.apply(signals(spark, sf_dir), kernel, "frames long, voiced long, f0 double")


@query("SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS \"end\", count(*)::BIGINT AS n FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, s")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from obsgrain.streaming.resume import sessions

    return sessions(read(spark, sf_dir, "events"), "user_id", "ts", "6 hours")


@query(
    "WITH t AS (SELECT nation.*, 'name = \"phones\" intervals: size = 2' || chr(10) || 'xmin = 0 xmax = ' || n_nationkey || '.5 text = \"' || n_name || '\"' || chr(10) || 'xmin = ' || n_nationkey || '.5 xmax = 99 text = \"\"' AS tg FROM nation) "
    "SELECT n_nationkey::BIGINT AS n_nationkey, i - 1 AS seq, CASE i WHEN 1 THEN 0 ELSE n_nationkey + 0.5 END::DOUBLE AS start, CASE i WHEN 1 THEN n_nationkey + 0.5 ELSE 99 END::DOUBLE AS \"end\", CASE i WHEN 1 THEN n_name ELSE 'sil' END AS label FROM t CROSS JOIN (SELECT unnest([1, 2]) AS i)"
)
def textgrid_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from obsgrain.sources.readers import textgrid_tier

    k = F.col("n_nationkey").cast("string")
    tg = F.concat(F.lit('name = "phones"\nintervals: size = 2\nxmin = 0 xmax = '), k, F.lit('.5 text = "'), F.col("n_name"), F.lit('"\nxmin = '), k, F.lit('.5 xmax = 99 text = ""\n'))
    d = read(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(textgrid_tier(tg)).alias("seq", "i"))
    return rounded(d.select("n_nationkey", "seq", "i.start", "i.end", "i.label"))


# -- utterances: embeddings as signals, turns of 1,000 samples as phones


#: Utterances of a task: some tenths of a second each.
_TASK_UTTERANCES = 128


def _utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """utt_id, samples (each embedding said over and over for a third of a second), sex, phones, formants and creak of every embedding."""
    phones = [(0, 800, "h#"), (800, 2400, "aa"), (2400, 2700, "tcl"), (2700, 3000, "t"), (3000, 4400, "iy"), (4400, 5120, "s")]
    said = F.array(*[F.struct(F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end"), F.lit(x).alias("label")) for a, b, x in phones])
    frames_ = 1 + (5120 - kernels.LENGTH) // kernels.HOP
    known = F.transform(F.sequence(F.lit(1), F.lit(frames_)), lambda k: F.array(*[(F.lit(500.0 * j) + k).cast("double") for j in (1, 3, 5, 7)]))
    sex = F.when(F.col("utt_id") % 2 == 0, "F").otherwise("M")
    creak = F.array(F.struct(F.lit(0.05).alias("start"), F.lit(0.1).alias("end")))
    d = signals(spark, sf_dir)
    # a task has so many utterances, however few files hold them; they are dealt before they grow to thousands of samples
    d = d.repartition(max(1, -(-d.count() // _TASK_UTTERANCES)), "utt_id")
    d = d.select("utt_id", F.flatten(F.array_repeat("samples", 80)).alias("samples"), sex.alias("sex"), said.alias("phones"))
    return d.withColumn("formants", known).withColumn("creak", creak)


@query(None)
def extract_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 features of every utterance, with formants and creak from outside."""
    return extract.extract(_utterances(spark, sf_dir))


@query("SELECT vec_id AS utt_id, round(100 * list_avg(list_transform(embedding, lambda v: (abs(v) > 0.999)::INT)), 6)::DOUBLE AS clip_pct FROM embeddings")
def recording_clipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(extract.recording_quality(_utterances(spark, sf_dir)).select("utt_id", "clip_pct"))


@query(None)
def recording_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal to noise, bandwidth and clipping of every utterance."""
    return rounded(extract.recording_quality(_utterances(spark, sf_dir)))


# -- sources and sinks, by round trip through the shared folder


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment FROM customer")
def roundtrip_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tsv")
    writers.tsv(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), path)
    return readers.tsv(spark, path)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def roundtrip_tsv_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a schema, and tolerant of broken lines."""
    path = scratch(spark, "tsv")
    writers.tsv(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    return readers.tsv(spark, path, "c_custkey long, c_name string, c_acctbal double", tolerant=True)


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM orders")
def roundtrip_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitioned by a column."""
    path = scratch(spark, "parquet")
    writers.parquet(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), path, ["o_orderpriority"])
    return spark.read.parquet(path).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey FROM supplier")
def roundtrip_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of JSON records by nation."""
    path = scratch(spark, "records")
    writers.record_tree(read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("nation"), "s_nationkey"), path, ["nation"])
    return rounded(spark.read.schema("s_suppkey long, s_name string, s_nationkey long").option("recursiveFileLookup", True).json(path))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, count(*) AS times FROM (SELECT * FROM nation UNION ALL SELECT * FROM nation WHERE n_regionkey = 1) GROUP BY ALL")
def roundtrip_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that was appended to twice."""
    path, n = scratch(spark, "log"), read(spark, sf_dir, "nation")
    for part in (n, n.where("n_regionkey = 1")):
        writers.append_log(part.select("n_nationkey", "n_name"), path)
    return rounded(spark.read.parquet(path).groupBy("n_nationkey", "n_name").agg(F.count(F.lit(1)).alias("times")))


@query("SELECT c_custkey::VARCHAR AS c_custkey, CASE WHEN c_nationkey < 10 THEN 'new ' || c_name ELSE c_name END AS c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def priority_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files in order, the second wins where it has a row; only customers with orders."""
    c, paths = read(spark, sf_dir, "customer"), [scratch(spark, "first"), scratch(spark, "second")]
    writers.tsv(c.select("c_custkey", "c_name"), paths[0])
    writers.tsv(c.where("c_nationkey < 10").select("c_custkey", F.concat(F.lit("new "), "c_name").alias("c_name")), paths[1])
    return readers.priority_files(spark, paths, "c_custkey", read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("c_custkey"))).select("c_custkey", "c_name")


@query(
    "WITH d AS (SELECT *, n_chars > 100 AS ok FROM documents) SELECT 'total' AS section, 'rows' AS item, count(*)::DOUBLE AS value FROM d UNION ALL SELECT 'total', 'decoded', count_if(ok)::DOUBLE FROM d UNION ALL SELECT 'total', 'failures', count_if(NOT ok)::DOUBLE FROM d UNION ALL SELECT 'total', 'entities', count(DISTINCT source)::DOUBLE FROM d "
    "UNION ALL SELECT 'measured', 'lang', round(avg((lang IS NOT NULL)::INT), 6)::DOUBLE FROM d UNION ALL SELECT 'entity', source, count(*)::DOUBLE FROM d GROUP BY source UNION ALL SELECT 'failed', doc_id::VARCHAR, 1.0::DOUBLE FROM d WHERE NOT ok"
)
def run_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, measured share, rows of each source and failures by name."""
    d = read(spark, sf_dir, "documents").withColumn("ok", F.col("n_chars") > 100)
    return rounded(writers.run_manifest(d, ["lang"], "ok", "source", "doc_id"))


@query("WITH e AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders), h AS (SELECT least(floor((o_totalprice - a) / ((b - a) / 30)), 29)::BIGINT AS bin, a, b FROM orders, e) SELECT bin, round(a + bin * (b - a) / 30, 4) AS low, round(a + (bin + 1) * (b - a) / 30, 4) AS high, count(*) AS n FROM h GROUP BY bin, a, b")
def plot_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of a histogram."""
    return rounded(writers.plot_data(read(spark, sf_dir, "orders"), "o_totalprice"), 4)


@query("SELECT n_nationkey::BIGINT AS n_nationkey, 'train/' || n_regionkey || '/m' || lower(n_name) || '/sx' || n_nationkey || '.wav' AS path, 'train' AS split, n_regionkey::VARCHAR AS region, 'm' || lower(n_name) AS speaker_id, 'M' AS sex, 'sx' || n_nationkey AS basename FROM nation")
def path_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers from the parts of a path."""
    path = F.concat(F.lit("train/"), F.col("n_regionkey").cast("string"), F.lit("/m"), F.lower("n_name"), F.lit("/sx"), F.col("n_nationkey").cast("string"), F.lit(".wav"))
    return rounded(read(spark, sf_dir, "nation").select("n_nationkey", path.alias("path")).select("n_nationkey", "path", *readers.identifiers(F.col("path"))))


@query("SELECT s_suppkey, s_name AS said FROM supplier")
def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript lines without their leading numbers."""
    d = read(spark, sf_dir, "supplier")
    return d.select("s_suppkey", readers.transcript(F.concat(F.lit("0 "), (F.col("s_suppkey") * 100).cast("string"), F.lit(" "), "s_name")).alias("said"))


@query("SELECT n_regionkey::BIGINT AS n_regionkey, i - 1 AS seq, (i * 100)::BIGINT AS start, (i * 100 + 100)::BIGINT AS \"end\", 'p' || i AS label FROM nation, unnest(range(1, 4)) AS t(i) GROUP BY ALL")
def alignment_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment files, one a region, written and read; a line with fewer fields is left out."""
    path = scratch(spark, "aligned")
    lines = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.concat_ws(" ", i * 100, i * 100 + 100, F.concat(F.lit("p"), i.cast("string")))), "\n")
    regions = read(spark, sf_dir, "nation").select("n_regionkey").distinct()
    regions.select("n_regionkey", F.concat(lines, F.lit("\nbroken")).alias("value")).write.partitionBy("n_regionkey").text(path)
    d = readers.alignments(spark, path)
    return rounded(d.select(F.regexp_extract("path", "n_regionkey=([0-9]+)", 1).cast("long").alias("n_regionkey"), "seq", "start", "end", "label"))


def _packed(files: DataFrame, tar: bool) -> DataFrame:
    """(path, content) of WAV files, or of tar archives with one each, made from (utt_id, samples as 16-bit numbers)."""

    def run(batches):
        import io
        import tarfile
        import wave

        import numpy as np
        import pandas as pd

        for batch in batches:
            rows = []
            for utt, samples in zip(batch["utt_id"], batch["samples"], strict=True):
                out = io.BytesIO()
                with wave.open(out, "wb") as w:
                    w.setnchannels(1)
                    w.setsampwidth(2)
                    w.setframerate(16000)
                    w.writeframes(np.asarray(samples, "<i2").tobytes())
                raw = out.getvalue()
                if tar:
                    out = io.BytesIO()
                    with tarfile.open(fileobj=out, mode="w:gz") as t:
                        entry = tarfile.TarInfo(f"clips/{utt}.wav")
                        entry.size = len(raw)
                        t.addfile(entry, io.BytesIO(raw))
                    raw = out.getvalue()
                rows.append((f"{utt}.wav", raw))
            yield pd.DataFrame(rows, columns=["path", "content"])

    return files.mapInPandas(run, "path string, content binary")


_PCM = "SELECT vec_id::VARCHAR AS utt_id, 64::BIGINT AS n, round(list_sum(list_transform(embedding, lambda v: abs(trunc(greatest(least(v, 1), -1)::DOUBLE * 10000) / 32768.0))), 6) AS total FROM embeddings"


def _pcm(spark: SparkSession, sf_dir: str, tar: bool) -> DataFrame:
    return _packed(signals(spark, sf_dir).select("utt_id", F.transform("samples", lambda v: (F.greatest(F.least(v, F.lit(1.0)), F.lit(-1.0)) * 10000).cast("int")).alias("samples")), tar)


def _heard(d: DataFrame) -> DataFrame:
    total = F.aggregate(F.transform("samples", F.abs), F.lit(0.0), lambda a, b: a + b)
    return rounded(d.select(F.regexp_extract("path", r"([0-9]+)\.wav$", 1).alias("utt_id"), F.size("samples").cast("long").alias("n"), total.alias("total")))


@query(_PCM)
def wav_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings written as WAV and decoded."""
    return _heard(readers.decoded(_pcm(spark, sf_dir, False)))


@query(_PCM)
def tar_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings taken out of compressed archives and decoded."""
    found = readers.members(_pcm(spark, sf_dir, True), ".wav")
    return _heard(readers.decoded(found.select(F.col("name").alias("path"), "content")))


@query("SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey FROM supplier")
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as JSON objects and back."""
    d = writers.to_json_records(read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"), ["s_suppkey"])
    return rounded(d.select("s_suppkey", F.from_json("json", "s_name string, s_nationkey long").alias("j")).select("s_suppkey", "j.*"))


@query("SELECT user_id, 'a' AS feature, round(avg(value), 6) AS x, count(value) AS cov FROM events GROUP BY 1")
def flattened_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of features and coverage as columns."""
    g = read(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("v"), F.count("value").alias("c"))
    d = writers.flatten(g.select("user_id", F.create_map(F.lit("a"), "v").alias("features"), F.create_map(F.lit("a"), "c").alias("coverage")), ["a", "b"])
    return rounded(d.where("b is null").select("user_id", F.lit("a").alias("feature"), F.col("a").alias("x"), F.col("cov_a").alias("cov")))
