"""Identity of objects across sources: scores, reconciliation, bindings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import name_similarity, nfkc_casefold
from ..functions.values import is_present
from ..sources.snapshots import cut_lineage


def reconcile(rows: DataFrame, key: str, field: str, value: str) -> DataFrame:
    """Fields of a source's objects: one normalised value is kept, several are a conflict and give none."""
    out = rows.where(is_present(value)).withColumn("_n", nfkc_casefold(value)).groupBy(key, field).agg(F.count_distinct("_n").alias("_k"), F.min(value).alias("value"), F.array_sort(F.collect_set(value)).alias("values"))
    return out.select(key, field, F.when(F.col("_k") == 1, F.col("value")).alias("value"), (F.col("_k") > 1).alias("conflict"), "values")


def similar_names(sources: DataFrame, masters: DataFrame, similar: float) -> DataFrame:
    """Pairs of different names (s_name of sources, m_name of masters) whose ratio of matching blocks reaches ``similar``.

    Matching blocks are common characters, so names of lengths a and b share at least ``need`` = similar * (a + b) / 2
    of them, repeats counted. Names of the same characters are one class. Its characters are ordered by how many pairs
    of classes they would join; of two classes that share ``need``, the first two shared ones (for long names, the
    first) are among the first a - need + 2 and b - need + 2. Classes meet by these, once for a pair of classes, and
    only names of classes that share enough are compared. No pair is lost.
    """
    if not 0 < similar <= 1:
        raise ValueError(f"similar must be above 0 and at most 1, not {similar}")

    def names(df, side):
        n = df.select(f"{side}_name").where(F.col(f"{side}_name") != "").distinct()
        return cut_lineage(n.withColumn(f"{side}_class", F.array_join(F.sort_array(F.split(f"{side}_name", "")), "")))

    def characters(named, side):
        c = F.col(f"{side}_class")
        times = lambda x: F.length(c) - F.length(F.replace(c, x, F.lit("")))
        each = lambda x: F.transform(F.sequence(F.lit(1), times(x)), lambda i: F.ascii(x).cast("long") * 2**24 + i)
        return named.select(c).distinct().select(c, F.explode(F.flatten(F.transform(F.array_distinct(F.split(c, "")), each))).alias("_c"))

    named = {"s": names(sources, "s"), "m": names(masters, "m")}
    chars = {side: characters(n, side) for side, n in named.items()}
    counted = chars["s"].select("_c", F.lit(1).alias("s"), F.lit(0).alias("m")).unionByName(chars["m"].select("_c", F.lit(0).alias("s"), F.lit(1).alias("m")))
    weight = F.ceil(F.log2(1 + F.sum("s").cast("double") * F.sum("m"))).cast("long")
    weights = counted.groupBy("_c").agg(weight.alias("_w"))
    classes = {side: c.join(weights, "_c").groupBy(f"{side}_class").agg(F.sort_array(F.collect_list(F.col("_w") * 2**45 + F.col("_c"))).alias(f"{side}_chars")).withColumn(side, F.size(f"{side}_chars")) for side, c in chars.items()}

    lengths = {side: c.select(F.length(f"{side}_class").alias(side)).distinct() for side, c in named.items()}
    least, most = F.ceil(F.col("s") * (similar / (2 - similar)) - 1e-9), F.floor(F.col("s") * ((2 - similar) / similar) + 1e-9)
    both = lengths["s"].select("s", F.explode(F.sequence(least.cast("int"), most.cast("int"))).alias("m")).join(lengths["m"], "m")
    both = both.withColumn("need", F.ceil((F.col("s") + F.col("m")) * (similar / 2) - 1e-9).cast("int"))
    both = both.withColumn("width", F.when((F.col("need") > 1) & (F.greatest("s", "m") - F.col("need") <= 14), 2).otherwise(1))

    def keyed(side):
        first = F.slice(f"{side}_chars", F.lit(1), F.col(side) - F.col("need") + F.col("width"))
        twos = F.flatten(F.transform("_first", lambda x, i: F.transform(F.slice("_first", i + 2, F.size("_first")), lambda y: F.array(x, y))))
        keys = F.when(F.col("width") == 2, twos).otherwise(F.transform("_first", lambda x: F.array(x)))
        return classes[side].join(both, side).withColumn("_first", first).select("s", "m", "need", "width", f"{side}_class", f"{side}_chars", F.explode(keys).alias("_key"))

    shared = F.array_intersect("s_chars", "m_chars")
    met = keyed("s").join(keyed("m").drop("need", "width"), ["s", "m", "_key"]).where((F.size(shared) >= F.col("need")) & (F.slice(shared, F.lit(1), F.col("width")) == F.col("_key")))
    pairs = met.select("s_class", "m_class").join(named["s"], "s_class").join(named["m"], "m_class").select("s_name", "m_name").where("s_name <> m_name")
    return pairs.where(name_similarity("s_name", "m_name") >= similar)


def proposals(sources: DataFrame, masters: DataFrame, *, similar: float = 0.8) -> DataFrame:
    """Scored pairs of sources and masters, to be reviewed; the best first within a source is ``place`` 1.

    Both have id, name, route, side, start_m, end_m, namespace, external_id (null where unknown). 100: same registered
    key; 90: same range, route and side; 70: same name; 60: same range; 50: overlapping range on one route; 25:
    similar name. Pairs meet by key, name, range, or route and kilometre, each by the first of these that they share;
    ``similar_names`` finds the others. Every pair with a score is returned.
    """

    def prepared(df, side):
        cols = ["id", "_name", "route", "side", "start_m", "end_m", "namespace", "external_id"]
        untyped = [c for c, kind in df.dtypes if kind == "void"]
        named = df.withColumns({c: F.col(c).cast("string") for c in untyped}).withColumn("_name", nfkc_casefold("name"))
        return cut_lineage(named.select(*[F.col(c).alias(f"{side}_{c.strip('_')}") for c in cols]).distinct())

    def blocks(df, side):
        c = lambda name: F.col(f"{side}_{name}")
        block = lambda kind, km, *parts: F.struct(F.lit(kind).alias("by"), km.cast("long").alias("km"), *[p.cast("string").alias(f"k{i}") for i, p in enumerate(parts)])
        km = F.sequence(F.floor(c("start_m") / 1000).cast("long"), F.floor(c("end_m") / 1000).cast("long"))
        spans = F.when(c("route").isNotNull() & (c("start_m") <= c("end_m")), F.transform(km, lambda k: block(3, k, c("route"), F.lit(""))))
        keyed = F.when(is_present(c("namespace")) & is_present(c("external_id")), block(0, F.lit(0), c("namespace"), c("external_id")))
        named = F.when(c("name") != "", block(1, F.lit(0), c("name"), F.lit("")))
        ranged = F.when(c("start_m").isNotNull() & c("end_m").isNotNull(), block(2, F.lit(0), c("start_m").cast("double") + 0.0, c("end_m").cast("double") + 0.0))
        found = F.array_compact(F.array(keyed, named, ranged))
        return df.withColumn("_block", F.explode(F.when(spans.isNull(), found).otherwise(F.concat(found, spans)))).select("_block.*", *df.columns)

    eq = lambda c: F.coalesce(F.col(f"s_{c}") == F.col(f"m_{c}"), F.lit(False))
    differ = lambda c: F.coalesce(F.col(f"s_{c}") != F.col(f"m_{c}"), F.lit(False))
    known = F.col("s_start_m").isNotNull() & F.col("s_end_m").isNotNull() & F.col("m_start_m").isNotNull() & F.col("m_end_m").isNotNull()
    meets = F.greatest("s_start_m", "m_start_m") <= F.least("s_end_m", "m_end_m")
    same_key = eq("namespace") & eq("external_id") & is_present("s_namespace") & is_present("s_external_id")
    same_name = eq("name") & (F.col("s_name") != "")
    same_range = known & eq("start_m") & eq("end_m")
    overlap = known & eq("route") & meets
    first = F.when(same_key, 0).when(same_name, 1).when(same_range, 2).when(overlap, 3)
    first_km = F.when(F.col("by") < 3, 0).otherwise(F.floor(F.greatest("s_start_m", "m_start_m") / 1000))

    s, m = prepared(sources, "s"), prepared(masters, "m")
    on = ["by", "km", "k0", "k1"]
    met = blocks(s, "s").join(blocks(m, "m"), on).where((F.col("km") == first_km) & (F.col("by") == first)).drop(*on)
    alike = similar_names(s, m, similar).join(s, "s_name").join(m, "m_name").where(first.isNull())
    score = F.when(same_key, 100).when(same_range & eq("route") & eq("side"), 90).when(same_name, 70).when(same_range, 60).when(overlap, 50).otherwise(25)
    against = {**{c: differ(c) for c in ("namespace", "route", "side")}, "range": known & ~same_range & ~meets}
    bits = sum((F.when(c, 2**i).otherwise(0) for i, c in enumerate(against.values())), F.lit(0))
    out = met.unionByName(alike).select(F.col("s_id").alias("source_id"), F.col("m_id").alias("master_id"), score.alias("score"), bits.alias("_against"))
    place = F.row_number().over(Window.partitionBy("source_id").orderBy(F.col("_against") > 0, F.col("score").desc(), "master_id", "_against"))
    conflicts = F.array_compact(F.array(*[F.when(F.col("_against").bitwiseAND(2**i) > 0, c) for i, c in enumerate(against)]))
    return out.withColumn("place", place).select("source_id", "master_id", "score", conflicts.alias("conflicts"), "place")


def active_bindings(history: DataFrame) -> DataFrame:
    """The newest event of each binding, if it isn't a release: history stays, influence goes."""
    newest = history.groupBy("binding_id").agg(F.max_by(F.struct("master_id", "action", "seq"), "seq").alias("e"))
    return newest.where("e.action <> 'release' and e.master_id is not null").select("binding_id", "e.master_id", "e.seq")


def stale_revisions(changes: DataFrame, current: DataFrame) -> DataFrame:
    """Changes (id, expected_revision) that don't name the revision that is stored: to be refused."""
    return changes.join(current.select("id", "revision"), "id", "left").where(~F.col("expected_revision").eqNullSafe(F.col("revision"))).select(*changes.columns)


def resolve_entities(mentions: DataFrame, known: DataFrame) -> DataFrame:
    """Mentions (mention_id, supplied_id, kind, name, context) with the entity they belong to: by supplied id if it is
    known, else by canonical kind, name and context, else a new entity named by that key."""
    key = lambda: F.concat_ws("|", "kind", nfkc_casefold("name"), F.coalesce("context", F.lit("")))
    k = known.select(F.col("entity_id").alias("_by_key"), key().alias("_key")).dropDuplicates(["_key"])
    ids = known.select(F.col("entity_id").alias("supplied_id"), F.lit(True).alias("_known")).distinct()
    out = mentions.withColumn("_key", key()).join(ids, "supplied_id", "left").join(k, "_key", "left")
    fresh = F.concat(F.lit("entity_"), F.substring(F.sha1(F.col("_key").cast("binary")), 1, 12))
    return out.select("mention_id", F.when(F.col("_known"), F.col("supplied_id")).otherwise(F.coalesce("_by_key", fresh)).alias("entity_id"))
