"""Source readers on small hand-made files (FIXTURES.md section 2)."""

import io
import json
import os
import zipfile

from pyspark.sql import functions as F

from textprov.sources import jsonstream, readers


def test_qa_jsonl(spark, tmp):
    p = os.path.join(tmp, "qa.jsonl")
    recs = [
        {"id": 1, "question": "Q1", "human_answers": ["h1", "h2"], "chatgpt_answers": ["a1"]},
        {"id": 2, "human_answers": ["no question"]},
        {"id": 3, "question": "Q3", "human_answers": [], "chatgpt_answers": []},
        {"id": 4, "question": "Q4"},
    ]
    with open(p, "w") as f:
        for r in recs:
            f.write(json.dumps(r) + "\n")
        f.write('{"id": 5, "question": "broken\n')
    rows, bad = readers.read_qa_jsonl(spark, p)
    got = sorted((r.record_id, r.label, r.answer_pos, r.text) for r in rows.collect())
    assert got == [(1, 0, 0, "Q1\nh1"), (1, 0, 1, "Q1\nh2"), (1, 1, 0, "Q1\na1"), (2, 0, 0, "no question")]
    assert bad.count() == 1
    assert rows.select("example_id").distinct().count() == 4


def test_labelled_csv(spark, tmp):
    d = os.path.join(tmp, "news")
    os.makedirs(d)
    rows = [
        ("a, quoted comma " + "x" * 40, "human"),
        ("line one\nline two " + "y" * 40, "gpt3"),
        ('He said ""hi"" ' + "z" * 40, "human"),
        ("w" * 49, "human"), ("v" * 50, "human"), ("u" * 51, "grover"),
    ]
    with open(os.path.join(d, "part.csv"), "w") as f:
        f.write("Generation,label\n")
        for t, g in rows:
            f.write('"' + t + '",' + g + "\n")
        f.write('"only one column"\n')
    got = readers.read_labelled_csv(spark, d).collect()
    texts = sorted((r.text, r.label) for r in got)
    assert len(texts) == 5  # 49 characters and the one-column row are dropped
    assert ("a, quoted comma " + "x" * 40, 0) in texts
    assert ("line one\nline two " + "y" * 40, 1) in texts
    assert ('He said "hi" ' + "z" * 40, 0) in texts
    assert ("v" * 50, 0) in texts and ("u" * 51, 1) in texts


def test_poly_json(spark, tmp):
    root = os.path.join(tmp, "Essays")
    os.makedirs(os.path.join(root, "A_TASK1"))
    long = "L" * 60
    with open(os.path.join(root, "A_TASK1", "gpt.json"), "w") as f:
        json.dump([long + "1", 5, None, "short", long + "2"], f)
    with open(os.path.join(root, "A_TASK1", "hum.json"), "w") as f:
        json.dump([{"text": "", "essay": long + "3"}, {"text": None, "content": long + "4"}, {"x": 1}], f)
    with open(os.path.join(root, "top.json"), "w") as f:
        json.dump({"k1": long + "5", "k2": {"nested": long}}, f)
    with open(os.path.join(root, "broken.json"), "w") as f:
        f.write("[not json")
    with open(os.path.join(root, "ignored.txt"), "w") as f:
        f.write("[]")
    rows, bad = readers.read_poly_json(spark, root)
    got = sorted((r.domain, r.label, r.text[-1]) for r in rows.collect())
    assert got == [
        ("student_essays_A_TASK1", 0, "3"), ("student_essays_A_TASK1", 0, "4"),
        ("student_essays_A_TASK1", 1, "1"), ("student_essays_A_TASK1", 1, "2"),
        ("student_essays_top.json", 0, "5"), ("student_essays_top.json", 0, "}"),
    ]
    assert bad.count() == 1
    # the folder's place does not enter the ids
    import shutil
    shutil.copytree(root, os.path.join(tmp, "elsewhere", "Essays"))
    again, _ = readers.read_poly_json(spark, os.path.join(tmp, "elsewhere", "Essays"))
    assert sorted(r.example_id for r in again.collect()) == sorted(r.example_id for r in rows.collect())


PIECES = [
    ("[]", []), (" \n[ 1 , 2.5e3,true ,null]\n", ["1", "2.5e3", "true", "null"]), ('["a","b\\"]["]', ['"a"', '"b\\"]["']),
    ('{"k": "v", "n": {"x": [1, {"y": "}"}]}}', ['"v"', '{"x": [1, {"y": "}"}]}']), ("{}", []), ('"scalar"', []), ("12", []),
    ('["\\u00e9\\ud83d\\ude00", "é😀"]', ['"\\u00e9\\ud83d\\ude00"', '"é😀"']), ("[123456, 7]", ["123456", "7"]),
]
BROKEN = ["[not json", "[1, 2", '{"a" 1}', '{"a": 1,}', "[1] x", '["open', "", "{1: 2}", "[1,,2]", '{"a": }']


def test_json_elements_in_pieces_of_any_size():
    """Whatever the pieces, the elements are those of the whole text."""
    from textprov.sources.jsonstream import Broken, Elements
    for text, want in PIECES:
        for size in (1, 2, 3, 7, 100):
            got = list(Elements(iter([text[i:i + size] for i in range(0, len(text), size)])))
            assert [e for _, _, _, e in got] == want, (text, size)
            assert [json.loads(e) for e in want] == ([] if not got else list(
                json.loads(text).values() if got[0][0] == "object" else json.loads(text)))
    for text in BROKEN:
        for size in (1, 3, 100):
            if text == "":
                continue
            try:
                list(Elements(iter([text[i:i + size] for i in range(0, len(text), size)])))
            except Broken:
                continue
            raise AssertionError(text)


def test_json_file_of_many_ranges_is_read_in_bounded_memory(spark, tmp):
    from textprov.sources import jsonstream
    path = os.path.join(tmp, "big.json")
    n = 20_000
    with open(path, "w") as f:
        f.write("[" + ",\n".join(json.dumps(f"text {i} " + "é" * (i % 90)) for i in range(n)) + "]")
    with open(path, "rb") as f:
        elements = jsonstream.Elements(jsonstream.decoded(f, 4096))
        assert sum(1 for _ in elements) == n
    assert os.path.getsize(path) > 300 * 4096 and elements.held < 4 * 4096
    got = jsonstream.load(spark, tmp, range_bytes=4096)
    assert got.count() == n and got.filter("error IS NOT NULL").count() == 0
    assert got.agg(F.max("position")).first()[0] == n - 1


def test_zip_members_are_partitions_and_ids_free_of_the_path(spark, tmp):
    import shutil

    from textprov.sources import writers
    ex = spark.createDataFrame([(i, f"text, number {i}\nwith \"quotes\" " + "w" * 60, i % 2, "src") for i in range(300)],
                               "example_id long, text string, label int, source string")
    root = writers.write_zipped_csv(ex, os.path.join(tmp, "a", "zips"), archives=3, members=2)
    raw = readers.zipcsv.load(spark, root)
    assert raw.rdd.getNumPartitions() == 6 and raw.select("archive", "member").distinct().count() == 6
    got = readers.read_zipped_csv(spark, root)
    assert sorted((r.text, r.label) for r in got.collect()) == sorted((r.text, r.label) for r in ex.collect())
    shutil.copytree(root, os.path.join(tmp, "b", "zips"))
    there = readers.read_zipped_csv(spark, os.path.join(tmp, "b", "zips"))
    ids = sorted(r.example_id for r in got.collect())
    assert len(set(ids)) == 300 and sorted(r.example_id for r in there.collect()) == ids


def test_a_source_that_fails_in_a_task_loses_its_stage_only(spark, tmp):
    from pyspark.sql.functions import udf

    from textprov.sources import staging
    schema = "example_id long, text string, label int, source string, domain string"

    def good(first):
        return lambda: spark.createDataFrame([(i, f"t{i}", 0, "s", "d") for i in range(first, first + 20)], schema)

    def failing():
        def fail(t):
            if t == "t7":
                raise ValueError("no such text")
            return t
        return good(0)().repartition(4).withColumn("text", udf(fail)("text"))

    def broken():
        return good(40)(), spark.createDataFrame([("f", "line")], "file_path string, record string")
    sources = {"qa": good(0), "news": failing, "essays": broken, "gone": lambda: spark.read.parquet(tmp + "/missing")}
    got = staging.stage_all(spark, tmp + "/stages", sources)
    assert {n: (s.rows.count(), s.quarantine.count(), s.error is None) for n, s in got.items()} == {
        "qa": (20, 0, True), "news": (0, 0, False), "essays": (20, 1, True), "gone": (0, 0, False)}
    assert got["news"].error.startswith("news: PythonException")
    # a later run reads what is there and tries the others again
    again = staging.stage_all(spark, tmp + "/stages", sources | {"news": good(60), "qa": failing})
    assert {n: (s.rows.count(), s.error is None) for n, s in again.items()} == {
        "qa": (20, True), "news": (20, True), "essays": (20, True), "gone": (0, False)}


def test_zipped_csv(spark, tmp):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("data/a.csv", "text,gen\n" + '"' + "t" * 60 + '",human\n' + '"' + "s" * 60 + '",gpt2\nshort,human\n')
        z.writestr("__MACOSX/data/a.csv", "text,gen\n" + '"' + "m" * 60 + '",human\n')
    with open(os.path.join(tmp, "n.zip"), "wb") as f:
        f.write(buf.getvalue())
    got = sorted((r.text[0], r.label) for r in readers.read_zipped_csv(spark, os.path.join(tmp, "*.zip")).collect())
    assert got == [("s", 1), ("t", 0)]


def test_union_sources_missing_columns(spark):
    a = spark.createDataFrame([(1, "x", 0, "qa", "qa")], "example_id long, text string, label int, source string, domain string")
    b = spark.createDataFrame([(2, "y", 1, "news", "news", "gpt")],
                              "example_id long, text string, label int, source string, domain string, generator string")
    c = spark.createDataFrame([(3, "   ", 1, "e", "e")], "example_id long, text string, label int, source string, domain string")
    u = readers.union_sources(a, b, c)
    assert sorted((r.example_id, r.generator) for r in u.collect()) == [(1, None), (2, "gpt")]


def test_optional_input_and_schema_peek(spark, tmp):
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("a", T.LongType())])
    assert readers.read_optional(spark, tmp + "/missing", schema).count() == 0
    spark.range(3).withColumnRenamed("id", "a").write.parquet(tmp + "/p")
    assert readers.read_optional(spark, tmp + "/p", schema).count() == 3
    assert readers.peek_columns(spark, tmp + "/p") == ["a"]


def test_corpus_prepare_writes_splits(spark, tmp):
    from textprov.plans import corpus
    from textprov.plans.q_sources import qa_rows
    qa, _ = qa_rows(spark, "/root/testdata/sf0.01")
    c = corpus.clean_corpus(qa)
    res = corpus.prepare(spark, c, tmp + "/corpus", min_tokens=1, vocab_size=500, max_len=512)
    rep = {r.split: r.n for r in res["split_report"].collect()}
    n = c.count()
    assert sum(rep.values()) <= n and set(rep) == {"train", "val", "test"}
    assert res["splits"].filter(F.size("input_ids") > 512).count() == 0


def test_failing_source_is_isolated(spark, tmp):
    good = spark.createDataFrame([(1, "x" * 60, 0, "qa", "qa")], "example_id long, text string, label int, source string, domain string")
    bad_df, none, err = readers.isolated(spark, "news", lambda: readers.read_labelled_csv(spark, tmp + "/missing"))
    assert bad_df.count() == 0 and none.count() == 0 and err.startswith("news: ")
    ok_df, none, err2 = readers.isolated(spark, "qa", lambda: good)
    assert err2 is None and none.count() == 0
    assert readers.union_sources(ok_df, bad_df).count() == 1


def test_quarantine_goes_with_the_corpus(spark, tmp):
    from textprov.plans import corpus
    with open(os.path.join(tmp, "qa.jsonl"), "w") as f:
        for i in range(40):
            f.write(json.dumps({"id": i, "question": "Q", "human_answers": [f"a {i}", f"b {i}"]}) + "\n")
        f.write("{broken\n")
    rows, bad, err = readers.isolated(spark, "qa", lambda: readers.read_qa_jsonl(spark, tmp + "/qa.jsonl"))
    res = corpus.prepare(spark, corpus.clean_corpus(rows), tmp + "/out", min_tokens=1, vocab_size=10, quarantine=[bad])
    assert err is None and [(r.source, r.record) for r in res["quarantine"].collect()] == [("qa", "{broken")]
    # both answers of a question are in one split
    per = res["splits"].groupBy("group_key").agg(F.count_distinct("split").alias("n"), F.count("*").alias("rows")).collect()
    assert len(per) == 40 and all(r.n == 1 and r.rows == 2 for r in per)


def test_small_json_files_share_a_task(spark, tmp):
    """Many small files of an essay folder are read by few tasks, each with its own path, label and break."""
    for domain in ("a", "b"):
        os.makedirs(f"{tmp}/root/{domain}")
        for i in range(60):
            kind, body = ("gpt", {"k": f"{domain}{i} " + "x" * 60}) if i % 2 else ("hum", [f"{domain}{i} " + "y" * 60, {"text": "z" * 70}])
            with open(f"{tmp}/root/{domain}/{kind}-{i:02d}.json", "w") as f:
                f.write(json.dumps(body) if i != 7 else '{"k": "' + "w" * 60 + '", ')
    rows, bad = readers.read_poly_json(spark, f"{tmp}/root")
    assert jsonstream.load(spark, f"{tmp}/root").rdd.getNumPartitions() <= 2
    got = rows.collect()
    assert sorted((r.domain[-1], r.label) for r in got) == sorted((d, i % 2) for d in "ab" for i in range(60) for _ in range(2 - i % 2))
    assert len({r.example_id for r in got}) == len(got) == 180 and bad.count() == 2


def test_files_of_a_task_are_bounded():
    listed = [(f"u{i}", f"f{i}", size) for i, size in enumerate([5, 10 ** 9, 0, *[100_000] * 500, 10 ** 8])]
    parts = jsonstream.grouped(listed, 1 << 20)
    assert [x for p in parts for x in p.files] == [(u, f) for u, f, _ in listed]
    size = {u: n for u, _, n in listed}
    assert all(len(p.files) == 1 or sum(size[u] for u, _ in p.files) <= 1 << 20 for p in parts)
    assert len(parts) < 110 and jsonstream.grouped([]) == []


def test_dropped_ids_are_found_once(spark, monkeypatch):
    from textprov.operators import dedup
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "a"), (6, "b")], "example_id long, text string")
    out = dedup.dedup_exact(df)
    assert sorted(r.example_id for r in out.collect()) == [1, 2, 4]
    # the plan of the result reads the stored ids and hashes no text
    assert "md5" not in out._jdf.queryExecution().optimizedPlan().toString().lower()


def _tables(spark, d, docs, labels, turns):
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{d}/conversations.parquet")


def _sql(d, name):
    import duckdb

    import __spark_entry__ as e
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet/*.parquet')")
    got = con.execute(e.oracle_sql()[name])
    names = [c[0] for c in got.description]
    return sorted((dict(zip(names, r)) for r in got.fetchall()), key=lambda r: str(sorted(r.items())))


def _rows(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: str(sorted(r.items())))


def _words(i):
    return " ".join(f"w{i}x{k}" for k in range(64 + i % 3))


TURNS = [(c, t, ("system", "user", "assistant")[t % 3], _words(1000 + 10 * c + t)) for c in range(8) for t in range(6)]


def test_corpus_prep_is_no_result_when_a_source_fails(spark, tmp, monkeypatch):
    """A failing reader, while it is planned or in a task, and records that cannot be read: raised, not left out."""
    import pytest

    import __spark_entry__ as e
    from textprov.plans import q_sources
    from textprov.sources import staging
    _tables(spark, tmp, [(i, _words(i), "s", "en") for i in range(40)], [(i, i % 2) for i in range(40)], TURNS)
    run = e.queries()["corpus_prep"]
    csv, qa = q_sources.csv_rows, q_sources.qa_rows
    stages = []
    monkeypatch.setattr(staging, "stage", lambda *a, first=staging.stage: stages.append((a[2], first(*a))) or stages[-1][1])

    def missing(spark, d, **kept):
        return readers.read_labelled_csv(spark, f"{d}/missing")

    def in_a_task(spark, d, **kept):
        return csv(spark, d, **kept).withColumn("text", F.when(F.col("text").startswith("w7x"), F.raise_error(F.lit("no such text"))).otherwise(F.col("text")))

    for failing in (missing, in_a_task):
        stages.clear()
        monkeypatch.setattr(q_sources, "csv_rows", failing)
        with pytest.raises(staging.SourcesNotWhole, match="^news: "):
            run(spark, tmp)
        # the other sources have their stages
        assert {n: s.rows.count() for n, s in stages} == {"qa": 32, "news": 0, "essays": 40}
    monkeypatch.setattr(q_sources, "csv_rows", csv)
    monkeypatch.setattr(q_sources, "qa_rows", lambda spark, d: qa(spark, d, broken_every=2))
    with pytest.raises(staging.SourcesNotWhole, match="^qa: [1-9] records in quarantine$"):
        run(spark, tmp)


def test_corpus_prep_holds_rows_without_domain_label_or_source_and_repeated_ids(spark, tmp):
    import __spark_entry__ as e
    langs, n = ("en", "de", "fr", "es", None, "a__b"), 120
    docs = [(i, _words(i), None if i % 11 == 0 else "s", langs[i % 6]) for i in range(n)]
    docs += [(i, _words(i + 500), "s", langs[i % 6]) for i in range(0, n, 2)]       # ids that come again, with another text
    docs += docs[:30]                                                            # and rows that come again
    labels = [(i, (0, 1, 0, None)[i % 4]) for i in range(n)]
    _tables(spark, tmp, docs, labels, TURNS)
    for name in ("src_poly_json", "corpus_prep"):
        assert _rows(e.queries()[name](spark, tmp)) == _sql(tmp, name), name


def test_corpus_prep_of_empty_tables(spark, tmp):
    import __spark_entry__ as e
    _tables(spark, tmp + "/a", [], [], TURNS)
    assert _rows(e.queries()["corpus_prep"](spark, tmp + "/a")) == _sql(tmp + "/a", "corpus_prep")
    _tables(spark, tmp + "/b", [(1, _words(1), "s", "en")], [(1, 1)], [])
    assert _rows(e.queries()["corpus_prep"](spark, tmp + "/b")) == _sql(tmp + "/b", "corpus_prep")


def test_essay_ids_are_unique_when_ids_repeat(spark, tmp):
    from textprov.sources import writers
    ex = spark.createDataFrame([(i % 7, _words(i), label, lang) for i in range(60) for label in (0, 1, None) for lang in ("en", "de", None)],
                               "example_id long, text string, label int, domain string")
    rows, bad = readers.read_poly_json(spark, writers.write_poly_json(spark, ex, tmp + "/essays"))
    got = rows.collect()
    assert len({r.example_id for r in got}) == len(got) == 540 and bad.count() == 0
    assert sorted((r.text, r.label, r.domain) for r in got if None not in (r.label, r.domain)) == sorted(
        (r.text, r.label, f"student_essays_{r.domain}") for r in ex.collect() if None not in (r.label, r.domain))


def test_of_equal_texts_one_with_a_label_stays(spark):
    from textprov.operators import dedup
    df = spark.createDataFrame([(1, "a", None), (2, "a", 1), (3, "a", 0), (4, "b", None), (5, "b", None), (6, None, 1)],
                               "example_id long, text string, label int")
    assert sorted(r.example_id for r in dedup.dedup_exact(df, label="label").collect()) == [2, 4, 6]
    assert sorted(r.example_id for r in dedup.dedup_exact(df).collect()) == [1, 4, 6]


def test_an_element_that_cannot_be_held_is_in_quarantine(spark, tmp):
    os.makedirs(tmp + "/root/a")
    with open(tmp + "/root/a/hum.json", "w") as f:
        f.write('["' + "x" * 60 + '", "' + "y" * (40 << 20) + '"]')
    rows, bad = readers.read_poly_json(spark, tmp + "/root")
    assert [r.text for r in rows.collect()] == ["x" * 60] and [r.record for r in bad.collect()] == ["unreadable element 1"]
