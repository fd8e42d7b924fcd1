"""Queries of the training-data operators over the engine's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import censor, confusable, encode, mainbody, names, neardup, pack, repeats, sitelines, templates
from newsloom.plans.materialize import materialize
from newsloom.sources.tables import table


class Pages:
    """What the queries on articles share: the hashes of their lines, the lines that sites share, and the articles left out."""

    def __init__(self, spark: SparkSession, d: str):
        self.articles, self.urls = table(spark, d, "articles"), table(spark, d, "urls")
        self.keyed = materialize(sitelines.keyed(self.articles, self.urls), "linekeys")
        self.known = sitelines.Known(self.keyed)

    def residue(self) -> DataFrame:
        return templates.residue(self.articles, self.urls, self.known)

    def left_out(self) -> DataFrame:
        return materialize(self.residue(), "residue")


def _repeated(p: Pages) -> DataFrame:
    return repeats.repeated_lines(p.articles, p.urls, p.left_out(), keyed=p.keyed)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines that stand in at least eight articles of their hostname."""
    return _repeated(Pages(spark, d)).select("article_id", "line_no")


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every article without the lines that its site repeats."""
    return repeats.without_repeated(table(spark, d, "articles"), p1_found(spark, d))


def p1_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Repeated lines and the articles they stand in, for each source."""
    found = _repeated(Pages(spark, d))
    return found.groupBy("source").agg(F.count_distinct("key").alias("lines"), F.count_distinct("article_id").alias("articles"), F.count("*").alias("places"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return censor.judged(*(table(spark, d, t) for t in ("ai_analyses", "articles", "urls")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Summaries that stop before their text is complete."""
    return _judged(spark, d).where("cut").select("analysis_id", "field").distinct()


def p2_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Share of cut values for each hostname and field."""
    return censor.cut_by_source(_judged(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines of articles that are no part of the story."""
    p = Pages(spark, d)
    return mainbody.off_lines(p.articles, p.left_out(), p.known)


def p3_body(spark: SparkSession, d: str) -> DataFrame:
    """Each article with its main body only."""
    p = Pages(spark, d)
    return mainbody.main_bodies(p.articles, p.known)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Articles that are template residue, filler or an error page."""
    return Pages(spark, d).residue().select("article_id")


def p4_reasons(spark: SparkSession, d: str) -> DataFrame:
    """How many articles are left out for which reason."""
    return Pages(spark, d).residue().groupBy("reason").agg(F.count("*").alias("articles"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of articles that tell the same story."""
    p = Pages(spark, d)
    return neardup.near_duplicate_pairs(p.articles, p.left_out(), p.known)


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each article with the class of its story."""
    p = Pages(spark, d)
    return neardup.near_duplicate_classes(p.articles, p.left_out(), p.known)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Articles whose university_name is another spelling of a listed institution."""
    return names.variant_spellings(table(spark, d, "articles"), table(spark, d, "institutions"))


def p6_entries(spark: SparkSession, d: str) -> DataFrame:
    """Each article with the entry of institutions that its university_name means."""
    return names.entries(table(spark, d, "articles"), table(spark, d, "institutions"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of each document."""
    return encode.encoded(table(spark, d, "documents"))


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Whether each document comes back from its ids."""
    return encode.round_trip(table(spark, d, "documents"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each container, for every spec."""
    return pack.packed(table(spark, d, "documents"), table(spark, d, "pack_specs"))


def p8_use(spark: SparkSession, d: str) -> DataFrame:
    """Containers of each spec and the share of their room in use."""
    return pack.use_of_room(p8_containers(spark, d), table(spark, d, "pack_specs"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents that look the same but are written with different characters."""
    return confusable.same_look_pairs(table(spark, d, "documents"))


def p9_text(spark: SparkSession, d: str) -> DataFrame:
    """Each document in its one consistent form."""
    return confusable.consistent(table(spark, d, "documents"))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each document with the class of its look."""
    return confusable.look_classes(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_clean, p1_by_source, p2_found, p2_by_source, p3_found, p3_body, p4_found, p4_reasons, p5_found, p5_classes, p6_found, p6_entries, p7_ids, p7_round_trip, p8_containers, p8_use, p9_found, p9_text, p9_classes)
}


# Written out apart from the operator's table: each word is a character and those that look like it.
_SQL_LOOKS = """aаɑ cсϲⲥⅽ dԁⅾ eе gցɡ hһհ iіⅰ jјϳ lӏⅼ mⅿ oоοօⲟ pрρⲣ qԛ sѕ uս vνѵⅴ wԝ xхⅹ yуү AАΑꓮᎪ BВΒꓐᏴ CСϹꓚᏟⲤⅭ DꓓᎠⅮ EЕΕꓰᎬ Fꓝ GԌꓖᏀ HНΗꓧᎻⲎ
    IІӀΙꓲⲒⅠ JЈͿꓙᎫ KКΚꓗᏦⲔ LꓡᏞⅬ MМΜꓟᎷⲘⅯ NΝꓠⲚ OОΟՕꓳⲞ PРΡꓑᏢⲢ QԚ RꓣᎡ SЅՏꓢᏚ TТΤꓔᎢⲦ Uꓴ VѴꓦᏙⅤ WԜꓪᎳ XХΧꓫⲬⅩ YУҮΥꓬᎩ ZΖꓜᏃ -‐‑﹣ :∶ /∕⁄ .․ ,‚ μµ ’ʼ ¢￠ £￡ ¬￢ ¦￤ ¥￥ ₩￦"""


def _same_look_sql() -> str:
    """The pairs of p9_found in SQL: SQL composes where the operator decomposes, which makes the same texts equal."""
    groups = _SQL_LOOKS.split()
    before, after = "".join(g[1:] for g in groups), "".join(g[0] * (len(g) - 1) for g in groups)
    full = "(SELECT string_agg(chr((65281 + i)::INTEGER), '' ORDER BY i) FROM range(94) t(i)), (SELECT string_agg(chr((33 + i)::INTEGER), '' ORDER BY i) FROM range(94) t(i))"
    hidden = "[\\p{Cf}\\x{FE00}-\\x{FE0F}\\x{34F}\\x{115F}\\x{1160}\\x{17B4}\\x{17B5}\\x{180B}-\\x{180D}\\x{180F}\\x{3164}\\x{FFA0}]"
    lines = "replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    return f"""WITH s AS (SELECT doc_id, text, nfc_normalize(translate(translate(regexp_replace(regexp_replace({lines}, '{hidden}', '', 'g'), '\\p{{Zs}}', ' ', 'g'), {full}), '{before}', '{after}')) AS look
    FROM documents WHERE text IS NOT NULL), t AS (SELECT * FROM s WHERE regexp_matches(look, '[^\\s]'))
    SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM t a JOIN t b ON a.look = b.look AND a.doc_id < b.doc_id AND a.text <> b.text"""


def __getattr__(name: str) -> dict[str, str]:
    """SQL of the queries that SQL can express, made when it is asked for."""
    if name == "ORACLE_SQL":
        return {"p9_found": _same_look_sql()}
    raise AttributeError(name)
