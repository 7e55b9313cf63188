import re

from helpers import SF, docs_frame, edge_texts, low, parity, rows_of, sha

from panelforge.llm import common, decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items, window=10):
    spans = {}
    for i, t in items:
        w = WORD.findall(low(t))
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if n else ():
            spans.setdefault(tuple(w[k:k + n]), set()).add(i)
    out = []
    for d, t in docs:
        w = WORD.findall(low(t))
        hit, found = set(), set()
        for n in {len(s) for s in spans}:
            for k in range(len(w) - n + 1):
                got = spans.get(tuple(w[k:k + n]))
                if got is not None:
                    hit.update(range(k, k + n))
                    found |= {str(x) for x in got if x is not None}
        out.append((len(hit) > 0, d, sha(",".join(sorted(found))), len(hit), len(found), len(w)))
    return sorted(out, key=repr)


def cases():
    texts = edge_texts()
    docs = list(enumerate(texts)) + [(5, texts[5]), (None, texts[5]), (None, None), (77, "one two three"), (78, "dup dup dup dup")]
    long = WORD.findall(texts[5])
    items = [(1, " ".join(long[3:16])), (2, " ".join(long[30:45])), (2, " ".join(long[30:45])), (10, " ".join(long[30:45]).upper().replace("É", "é")),
             (11, "two THREE"), (12, "dup " * 10), (13, "dup dup"), (14, None), (15, "!?"), (None, " ".join(long[40:52])), (16, "nowhere " * 12), (17, "three"),
             *[(30 + n, " ".join(long[n:2 * n])) for n in range(3, 10)]]
    return docs, items


def items_frame(spark, items):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id bigint, text string, gram string, length string")


def test_brute_force(spark):
    docs, items = cases()
    got = rows_of(decontam.digest(decontam.contamination(docs_frame(spark, docs), items_frame(spark, items))))
    assert got == brute(docs, items)


def test_shuffle_joins_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(common.small, "__defaults__", (0,))
    docs, items = cases()
    got = rows_of(decontam.digest(decontam.contamination(docs_frame(spark, docs), items_frame(spark, items))))
    assert got == brute(docs, items)


def test_long_words_are_not_broadcast(spark):
    from pyspark.sql import functions as F
    df = spark.range(300).select(F.repeat(F.lit("w"), 1 << 18).alias("gram"))
    hinted = lambda x: "ResolvedHint" in x._jdf.queryExecution().analyzed().toString()
    assert not hinted(common.small(df, size=F.octet_length("gram")))
    assert hinted(common.small(df.limit(200), size=F.octet_length("gram"))) and hinted(common.small(df))


def test_documents_are_read_once(spark, tmp_path):
    docs, items = cases()
    docs_frame(spark, docs).write.parquet(str(tmp_path / "docs"))
    spans, lengths = decontam._windows(items_frame(spark, items), 10)
    assert lengths == list(range(1, 11))
    hits = decontam.document_hits(spark.read.parquet(str(tmp_path / "docs")), spans, lengths)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f"{tmp_path}/docs") == 1


def test_every_window_has_a_fingerprint(spark):
    # the guarantee of winnowing, on a text of few words with many equal hashes
    from pyspark.sql import functions as F
    text = " ".join("abab"[(i * i) % 3] for i in range(120))
    for length in (1, 2, 3, 9, 10):
        df = spark.createDataFrame([(text,)], "text string")
        marks = df.select(decontam.winnow(decontam.words(F.col("text")), length).alias("m")).first()["m"]
        starts = [x["start"] for x in marks]
        span = length - (length + 1) // 2 + 1
        covered = {j for s in starts for j in range(s, s + span)}
        assert covered >= set(range(120 - length + 1))


def test_empty_tables_and_filter(spark):
    docs, items = cases()
    d, i = docs_frame(spark, docs), items_frame(spark, items)
    assert decontam.contamination(d.limit(0), i).count() == 0
    clean = decontam.contamination(d, i.limit(0))
    assert clean.count() == len(docs) and clean.filter("contaminated OR n_hit > 0 OR n_items > 0").count() == 0
    kept = decontam.drop_contaminated(d, i)
    assert kept.columns == d.columns
    want = sorted((str(b[1]) for b in brute(docs, items) if not b[0]))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == want
    assert decontam.drop_contaminated(d, i.limit(0)).count() == len(docs)


def test_sql(spark):
    parity(spark, "op1_decontaminate", SF)


def test_no_python_in_plan(spark):
    from panelforge.llm import queries as q
    plan = q.QUERIES["op1_decontaminate"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
