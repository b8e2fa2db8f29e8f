"""Tag sets, vectors and hybrid similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefgrid.functions.numeric import rnd
from reliefgrid.functions.similarity import ARCHETYPES, TagBits, archetype_entries, cosine, cosine_with_norms, dot, hybrid, jaccard, known_tags, leading_tags, tag_set, tag_words
from reliefgrid.operators.nearby import GROUP_ROWS, has_at_most, radius_join
from reliefgrid.plans.mapping import full_places, profiles, table
from reliefgrid.plans.registry import query
from reliefgrid.plans.sqltext import MATCH, PROFILES, r
from reliefgrid.session import cut_lineage


@query(
    "tag_sets",
    f"""WITH {PROFILES} SELECT l_suppkey, poi_tags, array_to_string(list_sort(tag_list),',') AS tag_set, len(tag_list)::INTEGER AS tag_count,
    array_to_string(string_split(poi_tags,' | ')[1:3],', ') AS leading FROM tags""",
)
def tag_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = profiles(spark, sf_dir).select("l_suppkey", "poi_tags").withColumn("t", tag_set("poi_tags"))
    return tags.select(
        "l_suppkey", "poi_tags", F.array_join(F.array_sort("t"), ",").alias("tag_set"), F.size("t").alias("tag_count"),
        leading_tags("poi_tags").alias("leading"),
    )


@query(
    "tag_set_messy",
    """SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(
      CASE WHEN starts_with(text,'[') AND ends_with(text,']') THEN string_split(regexp_replace(text,'^\\[|\\]$|["'']','','g'),',')
      WHEN contains(text,'|') THEN string_split(text,'|') WHEN contains(text,';') THEN string_split(text,';') ELSE string_split(text,',') END,
      lambda x: lower(trim(x))), lambda x: x<>''))),'^') AS tag_set FROM (SELECT doc_id, trim(text) AS text FROM documents)""",
)
def tag_set_messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts read as delimited tag strings."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.array_join(F.array_sort(tag_set("text")), "^").alias("tag_set"))


@query(
    "hybrid_similarity",
    f"""{MATCH} SELECT h_id, c_id, {r('cos_sim',6)} AS cosine_similarity, {r('jaccard_sim',6)} AS jaccard_similarity,
      {r('least(1e0,greatest(0e0,0.6e0*cos_sim+0.4e0*jaccard_sim))',6)} AS hybrid_similarity FROM pair WHERE straight_km<=120e0""",
)
def hybrid_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Norms and tag bitmaps are worked out once per place; a pair costs compiled arithmetic only."""
    entries = [f"v{k}" for k in range(len(ARCHETYPES))]
    base = full_places(spark, sf_dir).select(
        F.col("destination_id").alias("id"), "lat", "lon", *[v.alias(name) for name, v in zip(entries, archetype_entries(), strict=True)],
        F.when(F.col("poi_tags").isNotNull(), F.lit(1)).alias("raw"), tag_set("poi_tags").alias("tags"),
    )
    base = cut_lineage(base)
    known = known_tags(base, "tags")
    base, words = tag_words(base, "tags", known, "w")
    own = [F.col(name) for name in entries]
    base = base.withColumns({"norm": F.sqrt(dot(own, own)), "size": F.size("tags")})
    base = cut_lineage(base if known is None else base.drop("tags"))

    def side(p: str) -> tuple[DataFrame, list[Column], TagBits]:
        tags = TagBits([F.col(f"{p}_{w}") for w in words], F.col(f"{p}_size"), F.col(f"{p}_tags") if known is None else None)
        return base.select(*[F.col(x).alias(f"{p}_{x}") for x in base.columns]), [F.col(f"{p}_{v}") for v in entries], tags

    (h, h_vec, h_tags), (c, c_vec, c_tags) = side("h"), side("c")
    near = radius_join(
        h, c, ("h_lat", "h_lon"), ("c_lat", "c_lon"), right_key="c_id", left_key="h_id", radius_km=120.0,
        small_right=has_at_most(base, GROUP_ROWS),
    )
    cos = cosine_with_norms(h_vec, c_vec, F.col("h_norm"), F.col("c_norm"))
    return near.where("h_id <> c_id").withColumn("cos", cos).select(
        "h_id", "c_id", rnd("cos", 6).alias("cosine_similarity"), rnd(jaccard(h_tags, c_tags), 6).alias("jaccard_similarity"),
        rnd(hybrid(F.col("cos"), F.col("h_raw"), F.col("c_raw"), h_tags, c_tags), 6).alias("hybrid_similarity"),
    )


@query(
    "cosine_to_label",
    f"""WITH e AS (SELECT vec_id, label, unnest(range(0,len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
    m AS (SELECT label, i, {r('avg(v)',6)} AS c FROM e GROUP BY 1,2),
    d AS (SELECT vec_id, label, sum(v*c) AS dp, sqrt(sum(v*v)) AS nv, sqrt(sum(c*c)) AS nc FROM e JOIN m USING (label, i) GROUP BY 1,2)
    SELECT vec_id, label, {r('CASE WHEN nv>1e-9 AND nc>1e-9 THEN greatest(0e0,least(1e0,dp/(nv*nc))) ELSE 0e0 END',4)} AS cosine_similarity FROM d""",
)
def cosine_to_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of every vector to the mean vector of its label."""
    vectors = table(spark, sf_dir, "embeddings")
    entries = vectors.select("label", F.posexplode("embedding").alias("i", "v"))
    means = entries.groupBy("label", "i").agg(rnd(F.avg(F.col("v").cast("double")), 6).alias("c"))
    # one entry per dimension
    centres = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "c")))["c"].alias("centre"))
    return vectors.join(centres, "label").select(
        "vec_id", "label", rnd(cosine(F.col("embedding"), F.col("centre")), 4).alias("cosine_similarity")
    )


@query(
    "vector_norms",
    f"""SELECT vec_id, {r('sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE*x::DOUBLE)))',6)} AS norm FROM embeddings""",
)
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", rnd(F.sqrt(dot(e, e)), 6).alias("norm"))
