"""The languages of the text model, whatever their share; tables without labels."""

from pyspark.sql import functions as F

from loomgraph.llm import language


def rows_of(spark):
    words = {"en": "the cat sat on the mat and the dog", "xx": "zuqo vixi wamu kypo zuqo jexi"}
    rows = [(i, f"{words['en']} {i}", "en") for i in range(3000)] + [(5000 + i, f"{words['xx']} {i}", "xx") for i in range(3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)


def test_rare_languages_are_in_the_model(spark):
    docs = rows_of(spark)
    for bound in (1, 8):
        model = language.fit(docs, bound=bound)
        assert model.languages == ["en", "xx"]
    model = language.fit(docs, folds=1)
    got = language.identify(docs.withColumnRenamed("lang", "true"), model, "text", declared="true").where('lang = `true` and kept').count()
    assert got == docs.count()
    again = docs.unionByName(docs.where("lang = 'xx'")).unionByName(docs.where("lang = 'xx'"))
    assert language.fit(again, bound=8).languages == ["en", "xx"]


def test_tables_without_labels(spark):
    docs = rows_of(spark)
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    model = language.fit(bare)
    assert model.languages == [] and language.fit(docs.where("false")).languages == []
    found = language.identify(bare.withColumnRenamed("lang", "said"), model, "text", declared="said")
    rows = found.collect()
    assert len(rows) == docs.count() and all(r["lang"] is None and r["probability"] == 0 and not r["kept"] for r in rows)
    other = language.identify(docs, language.fit(docs), "text")
    assert found.schema["lang"].dataType == other.schema["lang"].dataType and set(found.columns) == {*other.columns, "said"}


def test_all_stages_take_an_empty_table(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for empty in (docs.where("false"), docs.withColumn("lang", F.lit(None).cast("string"))):
        for _, stage in corpus_pipeline.STAGES:
            empty = stage(spark, empty, sf)
            assert empty.count() == 0


def plain_posteriors(rows, model, held_out):
    """Bayes' rule with dicts. rows: (id, text, (host, domain, suffix), said, fold)."""
    import numpy as np

    size = len(model.languages)
    logs = {}
    for i, text, _, _, fold in rows:
        total, n = model.loglik(text, fold if held_out else None)
        logs[i] = (language.TEMPER * total, n)

    def soft(keep):
        total = np.zeros(size)
        for i, _, place, said, _ in rows:
            l, n = logs[i]
            if n and keep(place, said):
                e = np.exp(l - l.max())
                total += e / e.sum()
        return total

    world = soft(lambda *_: True) + 1
    world /= world.sum()
    smooth = lambda c, above: (c + language.HOST_ROWS * above) / (c.sum() + language.HOST_ROWS)
    out = {}
    for i, _, (host, domain, suffix), said, _ in rows:
        q = smooth(soft(lambda p, _: p[2] == suffix), world)  # noqa: B023
        q = smooth(soft(lambda p, _: p[1:] == (domain, suffix)), q)  # noqa: B023
        q = smooth(soft(lambda p, _: p == (host, domain, suffix)), q)  # noqa: B023
        claim = np.ones(size)
        if said:
            c = soft(lambda _, s: s == said)  # noqa: B023
            if said in model.languages:
                toward = np.array([0.9 if l == said else 0.1 / max(1, size - 1) for l in model.languages])
            else:
                toward = world
            claim = (c + language.DECLARED_ROWS * toward) / (c.sum() + language.DECLARED_ROWS) / world
        whole = logs[i][0] + np.log(q) + np.log(claim)
        p = np.exp(whole - whole.max())
        out[i] = (model.languages[int(whole.argmax())], float(p.max() / p.sum()))
    return out


def test_posteriors_are_those_of_plain_sums(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 120")
    docs = docs.withColumn("text", F.expr("case when doc_id % 11 = 0 then null when doc_id % 7 = 0 then substr(text, 1, 6) else substr(text, 1, 40) end"))
    docs = docs.withColumn("lang", F.expr("case when doc_id % 5 = 0 then null when doc_id % 13 = 0 then 'xx-YY' when doc_id % 17 = 0 then 'de' else lang end")).withColumn("host", F.lit("clash"))
    model = language.fit(docs)
    got = {r["doc_id"]: (r["lang"], r["probability"]) for r in language.identify(docs, model, "text", host="source", declared="lang", held_out=True).collect()}
    rows = [(r["doc_id"], r["text"], (r["source"] or "", "", ""), (r["lang"] or "").split("-")[0].lower(), r["f"]) for r in docs.withColumn("f", language.fold_of(F.col("text"), model.folds)).collect()]
    want = plain_posteriors(rows, model, True)
    assert set(got) == set(want)
    for i, (lang, p) in want.items():
        assert got[i][0] == lang and abs(got[i][1] - p) < 1e-9
    pages = [(i, f"http://{h}/x", f'<html lang="{l}"><p>{t}') for i, (h, l, t) in enumerate([("a.b.fr", "fr", "le chat"), ("a.b.fr", "", "die der"), ("c.b.fr", "de", "xyz"), ("d.de", "de-AT", "und die"), ("d.de", "zz", ""), ("e.de", "en", "the of and")])]
    got = {r["page_id"]: (r["lang"], r["probability"]) for r in language.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), model, "html", url="url", markup=True).collect()}
    rows = []
    for i, url, html in pages:
        host = url[7:-2]
        said = language._DECLARED.search(html)
        rows.append((i, language.markup_text(html), (host, ".".join(host.split(".")[-2:]), host.split(".")[-1]), said[1].lower() if said else "", None))
    want = plain_posteriors(rows, model, False)
    for i, (lang, p) in want.items():
        assert got[i][0] == lang and abs(got[i][1] - p) < 1e-9


def test_own_labels_say_nothing(spark):
    """With held_out, a text that only its own label ties to a language isn't tied to it."""
    rows = [(i, f"the cat sat on the mat {i}", "en") for i in range(40)] + [(50 + i, f"der hund und die katze {i}", "de") for i in range(40)] + [(99, "the dog sat on the mat and the cat", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    for held_out in (True, False):
        got = language.identify(docs.withColumnRenamed("lang", "true"), model, "text", held_out=held_out).where("doc_id = 99").first()
        assert got["lang"] == "en"
    assert set(language.identify(docs, model, "text", columns=["doc_id"]).columns) == {"doc_id", "lang", "probability", "kept"}


def test_clashing_names(spark):
    rows = [(i, "the cat sat on the mat", "en", "a", "b", "c", 1) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, __host string, `logs` string, `c0` string, kept int")
    got = language.identify(docs, language.fit(docs), "text", host="__host", declared="lang").collect()
    assert got[0]["__host"] == "a" and got[0]["logs"] == "b" and got[0]["c0"] == "c" and got[0]["kept"] is True


def test_run_takes_empty_tables_and_other_columns(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for name, rows in (("empty", docs.where("false")), ("bare", docs.withColumn("lang", F.lit(None).cast("string")))):
        rows.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
        assert corpus_pipeline.run(spark, str(tmp_path / name)).count() == 0
    names = ["__k1", "__host", "__text", "__id", "kept", "probability", "__row", "n_lines", "kept_text", "component"]
    extra = docs.limit(40)
    for n in names:
        extra = extra.withColumn(n, F.lit(f"own {n}"))
    for stage_name, stage in corpus_pipeline.STAGES:
        extra = spark.createDataFrame(stage(spark, extra, sf).collect(), extra.schema) if stage_name != "piece_encoding" else stage(spark, extra, sf)
        row = extra.first().asDict()
        assert all(row[n] == f"own {n}" for n in names), stage_name
