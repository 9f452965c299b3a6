"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strophe.llm import abuse, bpe, dedup, langid, lookalike, neardup, packing, reading, sampling
from strophe.session import spread, table

#: Share of the identifiers that p5_sample chooses.
SAMPLE_RATE = 0.1
#: Shortest text in p10_found.
LEAST_CHARS = 200


def songs_of(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """The songs' texts, over as many tasks as there are cores."""
    return spread(table(spark, sf_dir, "songs").select("row_id", "lyrics", *more))


def documents_of(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", *more))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.same_looking(songs_of(spark, sf_dir))


def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.repair(songs_of(spark, sf_dir)).select("row_id", "form")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.extra_copies(dedup.records_of(songs_of(spark, sf_dir), table(spark, sf_dir, "raw_lines")))


def p2_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.kept_records(dedup.records_of(songs_of(spark, sf_dir), table(spark, sf_dir, "raw_lines")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    songs = songs_of(spark, sf_dir, "lang")
    return langid.corrections(songs, langid.train(table(spark, sf_dir, "lang_samples"), songs))


def p4_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    songs = songs_of(spark, sf_dir, "lang")
    return langid.languages(songs, langid.train(table(spark, sf_dir, "lang_samples"), songs))


def p5_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample(table(spark, sf_dir, "songs").select("row_id", "idx"), SAMPLE_RATE)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.unlabelled_abuse(songs_of(spark, sf_dir, "source"), *(table(spark, sf_dir, t) for t in ("song_labels", "flag_terms")))


def p6_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.scores(songs_of(spark, sf_dir, "source"), *(table(spark, sf_dir, t) for t in ("song_labels", "flag_terms")))


def p6_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.rates(songs_of(spark, sf_dir, "source"), *(table(spark, sf_dir, t) for t in ("song_labels", "flag_terms")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(songs_of(spark, sf_dir))


def p7_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(songs_of(spark, sf_dir))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents_of(spark, sf_dir), bpe.load(spark))


def p9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = bpe.sizes(documents_of(spark, sf_dir), bpe.load(spark))
    return packing.pack(sizes, table(spark, sf_dir, "pack_sizes"))


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(p9_pack(spark, sf_dir), table(spark, sf_dir, "pack_sizes"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.ungraded(documents_of(spark, sf_dir, "lang"), table(spark, sf_dir, "level_labels"), LEAST_CHARS)


def p10_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.every_level(documents_of(spark, sf_dir, "lang"), table(spark, sf_dir, "level_labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"p5_sample": sampling.sql(SAMPLE_RATE)}
