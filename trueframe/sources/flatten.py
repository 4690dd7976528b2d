"""Nested JSON documents to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas

# Credential action labels and generative source types.
ACTION_LABELS = ("c2pa.actions", "c2pa.actions.v2")
SOURCE_TYPE_ROOT = "http://cv.iptc.org/newscodes/digitalsourcetype/"
GENERATIVE_SOURCE_TYPES = tuple(SOURCE_TYPE_ROOT + name for name in (
    "trainedAlgorithmicMedia", "compositeWithTrainedAlgorithmicMedia"))
MEDIA_NAME = r"(?i)\.(?:mp4|mov|mkv)\z"
DIGEST = r"^[0-9a-f]{64}\z"


def number(text: Column) -> Column:
    """A JSON number read as text; strings, booleans and other text become null."""
    return F.when(text.rlike(r"^-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?\z"), text.try_cast("double"))


def flatten_frames(docs: DataFrame, key: str, document: str = "document") -> DataFrame:
    """Provider frames as samples: milliseconds to seconds, ill-typed values null.

    Fields are read as text first, so a value of the wrong type spoils its own
    sample and not the document.
    """
    parsed = docs.select(key, F.from_json(document, schemas.FRAMES).alias("d"))
    return parsed.select(key, F.posexplode_outer("d.data.frames").alias("index", "f")).filter("f is not null").select(
        key, "index", (number(F.col("f.info.position")) / 1000).alias("position"), number(F.col("f.type.ai_generated")).alias("score"))


def flatten_probe(docs: DataFrame, key: str, document: str = "document") -> DataFrame:
    """Probe output: duration, size, frame rate from its fraction, audio flag; a
    row without a usable duration or size is rejected."""
    d = docs.select(key, F.from_json(document, schemas.PROBE).alias("d")).withColumn(
        "v", F.get(F.filter("d.streams", lambda s: s["codec_type"] == "video"), F.lit(0)))
    fraction = F.split("v.avg_frame_rate", "/")
    rate = F.try_divide(F.get(fraction, F.lit(0)).try_cast("double"), F.coalesce(F.get(fraction, F.lit(1)).try_cast("double"), F.lit(1.0)))
    whole = lambda c: F.when(c.rlike(r"^\d+\z"), c.try_cast("int"))
    out = d.select(
        key, F.col("d.format.duration").try_cast("double").alias("duration"), whole(F.col("v.width")).alias("width"), whole(F.col("v.height")).alias("height"),
        F.when(rate > 0, rate).alias("fps"), F.coalesce(F.exists("d.streams", lambda s: s["codec_type"] == "audio"), F.lit(False)).alias("has_audio"))
    ok = (F.col("duration") > 0) & (F.col("width") > 0) & (F.col("height") > 0)
    return out.withColumn("rejected", ~F.coalesce(ok, F.lit(False)))


def flatten_comments(docs: DataFrame, key: str, creator: Column, document: str = "document") -> DataFrame:
    """Comment threads as (text, is_creator); blank texts are dropped."""
    rows = docs.select(key, creator.alias("_c"), F.explode(F.from_json(document, schemas.COMMENTS)["items"]).alias("i"))
    s = F.col("i.snippet.topLevelComment.snippet")
    from ..functions.text import strip
    return rows.select(key, strip(s["textDisplay"]).alias("text"),
                       F.coalesce(s["authorChannelId"]["value"] == F.col("_c"), F.lit(False)).alias("is_creator")).filter("text <> ''")


def flatten_assertions(docs: DataFrame, key: str, document: str = "document") -> DataFrame:
    """Generative source types declared by an action of the active manifest only."""
    d = docs.select(key, F.from_json(document, schemas.CREDENTIALS).alias("d"))
    active = F.try_element_at("d.manifests", F.col("d.active_manifest"))
    acts = F.flatten(F.transform(F.filter(active["assertions"], lambda a: a["label"].isin(*ACTION_LABELS)),
                                 lambda a: F.coalesce(a["data"]["actions"], F.array().cast("array<struct<action:string,digitalSourceType:string>>"))))
    named = F.filter(acts, lambda a: (F.length(a["action"]) > 0) & a["digitalSourceType"].isin(*GENERATIVE_SOURCE_TYPES))
    types = F.array_distinct(F.transform(named, lambda a: a["digitalSourceType"]))
    state = F.col("d.validation_state")
    return d.select(
        key, F.coalesce(types, F.array().cast("array<string>")).alias("source_types"),
        F.when(state == "Invalid", "invalid").otherwise("found").alias("status"),
        F.coalesce(state.isin("Valid", "Trusted"), F.lit(False)).alias("valid"), F.coalesce(state == "Trusted", F.lit(False)).alias("trusted"))


def known_hashes(docs: DataFrame, document: str = "document") -> DataFrame:
    """Distinct media digests that documents register, at any depth.

    Each object names a digest beside a media path, or the digest of its source.
    A document is walked level by level inside its row: a fold holds the values
    of one level and puts their children in their place until none is left. No
    document is deeper than it has opening brackets, and steps past its depth do
    nothing. Objects may hold arrays and the reverse, in any mixture.
    """
    text = F.col(document)
    nothing = F.array().cast("array<variant>")
    levels = F.greatest(F.lit(1), F.length(F.regexp_replace(text, r"[^\[{]", "")))

    def children(v: Column) -> Column:
        return F.concat(F.coalesce(F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), nothing),
                        F.coalesce(F.try_variant_get(v, "$", "array<variant>"), nothing))

    def named(v: Column) -> Column:
        at = lambda path: F.try_variant_get(v, path, "string")
        return F.array(F.when(at("$.path").rlike(MEDIA_NAME), at("$.sha256")), at("$.cgiSourceSha256"))

    def step(seen: Column, _) -> Column:
        level = seen["level"]
        return F.when(F.size(level) == 0, seen).otherwise(F.struct(
            F.flatten(F.transform(level, children)).alias("level"),
            F.array_distinct(F.concat(seen["found"], F.array_compact(F.flatten(F.transform(level, named))))).alias("found")))

    start = F.struct(F.array(F.try_parse_json(text)).alias("level"), F.array().cast("array<string>").alias("found"))
    found = F.aggregate(F.sequence(F.lit(1), levels), start, step, lambda seen: seen["found"])
    return docs.select(F.explode(found).alias("sha256")).filter(F.col("sha256").rlike(DIGEST)).distinct()


def unreadable_documents(docs: DataFrame, key: str, document: str = "document") -> DataFrame:
    """Keys of documents that are no JSON, whose digests nobody can know."""
    return docs.filter(F.col(document).isNotNull() & F.try_parse_json(document).isNull()).select(key)
