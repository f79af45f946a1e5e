"""Scores of answers and of retrieval, one aggregate each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _points(c: Column) -> Column:
    return F.round(c, 4)


def closed_score(key: DataFrame, subs: DataFrame) -> DataFrame:
    """key(id, correcta) and subs(id, letra): hits over all key rows; a missing answer is a miss. 20 points."""
    hit = F.coalesce(F.upper("letra") == F.col("correcta"), F.lit(False)).cast("int")
    return key.join(subs, "id", "left").agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("aciertos"), _points(F.avg(hit) * 20).alias("puntos"))


def citation_score(items: DataFrame) -> DataFrame:
    """items(ref, cited, backed), arrays of bodies: recall weighted by backing, less twice the unbacked rate. 20 points.

    A null ``cited`` is a missing or abstained answer; its references still count.
    """
    cited, backed = F.coalesce("cited", F.array().cast("array<string>")), F.coalesce("backed", F.array().cast("array<string>"))
    hits = F.array_intersect("ref", cited)
    sums = items.agg(
        F.sum(F.size("ref")).alias("n_ref"),
        F.sum(F.size(cited)).alias("n_citadas"),
        F.sum(F.size(F.array_intersect(hits, backed))).alias("con_respaldo"),
        F.sum(F.size(F.array_except(hits, backed))).alias("sin_respaldo"),
        F.sum(F.size(F.array_except(cited, backed))).alias("no_respaldadas"),
    )
    recall = F.try_divide(F.col("con_respaldo") + 0.5 * F.col("sin_respaldo"), F.col("n_ref"))
    rate = F.coalesce(F.try_divide(F.col("no_respaldadas"), F.col("n_citadas")), F.lit(0.0))
    return sums.withColumn("puntos", _points(20 * F.greatest(F.lit(0.0), recall - 2 * rate)))


def abstention_score(key: DataFrame, subs: DataFrame) -> DataFrame:
    """key(id, correcta) and subs(id, letra, abstencion): right answers count 1, abstentions and errors by the confusion. 10 points."""
    joined = key.join(subs, "id", "left")
    away = F.coalesce("abstencion", F.lit(False))
    right = F.coalesce(F.col("letra") == F.col("correcta"), F.lit(False))
    missing = F.col("letra").isNull() & ~away
    out = joined.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~away & right).alias("tn"),
        F.count_if(away & ~right).alias("tp"),
        F.count_if(away & right).alias("fp"),
        F.count_if(missing | (~away & ~right)).alias("fn"),
    )
    return out.withColumn("puntos", _points(10 * (F.col("tn") + 0.5 * (F.col("tp") + F.col("fp"))) / F.col("n")))


def retrieval_ceiling(items: DataFrame) -> DataFrame:
    """items(area, formato, n_ref, n_hit, art_hit, n_docs): rates overall, by area and by format."""
    rolled = items.groupingSets([[], ["area"], ["formato"]], "area", "formato").agg(
        F.count(F.lit(1)).alias("n"),
        _points(F.avg((F.col("n_hit") > 0).cast("double"))).alias("body_hit"),
        _points(F.try_divide(F.sum("n_hit"), F.sum("n_ref"))).alias("recall"),
        _points(F.avg(F.col("art_hit").cast("double"))).alias("article_hit"),
        _points(F.avg("n_docs")).alias("mean_docs"),
    )
    return rolled


def latency(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Median, the lower 95th percentile (element int(0.95 (n - 1))) and the maximum.

    The percentile comes from a running count, so no list of a group is built.
    """
    own = Window.partitionBy(*keys)
    placed = rows.withColumn("_at", F.row_number().over(own.orderBy(value)) - 1).withColumn("_n", F.count(F.lit(1)).over(own))
    p95 = F.max(F.when(F.col("_at") == F.floor(0.95 * (F.col("_n") - 1)), F.col(value)))
    return placed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.median(value), 6).alias("p50"), F.round(p95, 6).alias("p95"), F.round(F.max(value), 6).alias("max"))


def projection(done: DataFrame, sizes: DataFrame) -> DataFrame:
    """done(formato, seconds) and sizes(formato, n): expected seconds, with the overall mean where a format has none."""
    means = done.groupBy("formato").agg(F.avg("seconds").alias("mean"))
    overall = done.agg(F.avg("seconds").alias("all"))
    joined = sizes.join(means, "formato", "left").crossJoin(F.broadcast(overall))
    return joined.select("formato", "n", F.round(F.coalesce("mean", "all") * F.col("n"), 4).alias("segundos"))


#: Points of each part of a report.
POINTS = {"cerradas": 20.0, "ragas": 30.0, "citas": 20.0, "abstencion": 10.0}


def answer_key(key: DataFrame, questions: DataFrame) -> DataFrame:
    """The key's rows with the text of their questions, for splits that keep both apart."""
    return key.join(questions.select("id", "pregunta"), "id")


def to_judge(judged: DataFrame, subs: DataFrame, key: DataFrame) -> DataFrame:
    """What a judge reads: judged(id) with subs(id, texto, abstencion) that did not abstain and key(id, pregunta, respuesta_esperada)."""
    said = subs.filter(~F.coalesce("abstencion", F.lit(False))).select("id", "texto")
    return judged.select("id").distinct().join(said, "id").join(key.select("id", "pregunta", "respuesta_esperada"), "id")


def judge_score(judged: DataFrame, verdicts: DataFrame) -> DataFrame:
    """judged(id) and verdicts(id, correctness): the mean over all judged, those without a verdict as 0. 30 points."""
    joined = judged.select("id").distinct().join(verdicts.withColumn("_v", F.lit(True)), "id", "left")
    value = F.when(F.isnan("correctness"), F.lit(0.0)).otherwise(F.coalesce("correctness", F.lit(0.0)))
    failed = F.col("_v") & (F.col("correctness").isNull() | F.isnan("correctness"))
    out = joined.agg(F.count(F.lit(1)).alias("n_juzgados"), F.count("_v").alias("n_respondidos"), F.count_if(failed).alias("n_fallidos"), F.avg(value).alias("_c"))
    return out.select("n_juzgados", "n_respondidos", "n_fallidos", _points(F.coalesce("_c", F.lit(0.0))).alias("correctness"),
                      F.round(POINTS["ragas"] * F.coalesce("_c", F.lit(0.0)), 2).alias("puntos"))


def total(parts: DataFrame) -> DataFrame:
    """parts(parte, puntos null where not scored): points reached, and possible of the parts that were scored."""
    most = F.element_at(F.create_map(*[F.lit(x) for pair in POINTS.items() for x in pair]), F.col("parte"))
    return parts.agg(F.round(F.sum("puntos"), 2).alias("obtenidos"), F.sum(F.when(F.col("puntos").isNotNull(), most)).alias("posibles"))


def sweep(configs: DataFrame, items: DataFrame) -> DataFrame:
    """Every item under every configuration; configurations are few, and only they are broadcast, up to 10,000."""
    n = configs.limit(10_001).count()
    if n > 10_000:
        raise ValueError("a sweep has at most 10,000 configurations")
    return items.crossJoin(F.broadcast(configs))


def seeded_sample(rows: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, the same for a seed whatever the partitions: those with the smallest hashes of the key."""
    return rows.orderBy(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), key).limit(n)


def named_probe(asked: DataFrame, passages: DataFrame) -> DataFrame:
    """asked(id, doc_id, body) against passages(id, pos, doc_id, bodies): how often the named document is among ten, first, and its body backed."""
    first = passages.filter("pos <= 10")
    by = asked.join(first.select("id", "pos", F.col("doc_id").alias("_doc"), "bodies"), "id", "left")
    per = by.groupBy("id").agg(
        F.coalesce(F.max(F.col("_doc") == F.col("doc_id")), F.lit(False)).alias("hit"),
        F.coalesce(F.max((F.col("_doc") == F.col("doc_id")) & (F.col("pos") == 1)), F.lit(False)).alias("first"),
        F.coalesce(F.max(F.array_contains("bodies", F.col("body"))), F.lit(False)).alias("backed"))
    rate = {n: F.round(F.avg(F.col(c).cast("double")), 3).alias(n) for n, c in (("hit10", "hit"), ("primero", "first"), ("respaldada", "backed"))}
    return per.agg(F.count(F.lit(1)).alias("n"), *rate.values())


def topic_probe(asked: DataFrame, passages: DataFrame, edges: DataFrame) -> DataFrame:
    """asked(id, body) against passages(id, pos, doc_id): harvested documents (in edges(doc_id, body)) a question, and the share that cites the body."""
    first = passages.filter("pos <= 10").select("id", "doc_id").distinct()
    found = asked.join(first.join(edges.select("doc_id").distinct(), "doc_id", "left_semi"), "id")
    citing = found.join(edges.select("doc_id", "body").distinct(), ["doc_id", "body"], "left_semi")
    sums = asked.agg(F.count(F.lit(1)).alias("n")).crossJoin(found.agg(F.count(F.lit(1)).alias("_r"))).crossJoin(citing.agg(F.count(F.lit(1)).alias("_c")))
    return sums.select("n", F.round(F.try_divide("_r", "n"), 2).alias("por_pregunta"), F.round(F.try_divide("_c", "_r"), 3).alias("citan_la_norma"))


def dense_report(items: DataFrame) -> DataFrame:
    """items(refs, backed, own), arrays of bodies (own: of the names of the first 50): hit and recall in ten, own norm in fifty."""
    some = items.filter(F.size("refs") > 0)
    common = F.size(F.array_intersect("refs", "backed"))
    return some.agg(F.count(F.lit(1)).alias("n"), _points(F.avg((common > 0).cast("double"))).alias("body_hit"), _points(F.try_divide(F.sum(common), F.sum(F.size("refs")))).alias("recall"),
                    _points(F.avg((F.size(F.array_intersect("refs", "own")) > 0).cast("double"))).alias("own"))


def harvest_report(rows: DataFrame) -> DataFrame:
    """rows(n_fragmentos, caracteres, ponente, decision, votos): totals, medians, shares with a flag, weight of separate votes."""
    def share(c: str) -> Column:
        return _points(F.avg(F.col(c).cast("double"))).alias(c)

    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("n_fragmentos").alias("fragmentos"), F.median("n_fragmentos").alias("mediana"), F.max("n_fragmentos").alias("maximo"),
                    share("ponente"), share("decision"), _points(F.try_divide(F.sum("votos"), F.sum("caracteres"))).alias("peso_votos"))


def characters_by(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum(F.length(text)).alias("caracteres"))


def stage_seconds(rows: DataFrame) -> DataFrame:
    """rows(id, etapa, segundos): seconds of each stage of a question, repeats added."""
    return rows.groupBy("id", "etapa").agg(F.round(F.sum("segundos"), 6).alias("segundos"))


def correct_option(options: Column) -> Column:
    """The text of the first option of an array of (text, is_correct) that is right."""
    return F.get(F.filter(options, lambda o: o["is_correct"]), F.lit(0))["text"]


def markdown(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """``line``, the rows as lines of a Markdown table in ``order``; bars in cells become slashes."""
    cells = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", "/") for c in columns]
    return rows.select(*order, F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
