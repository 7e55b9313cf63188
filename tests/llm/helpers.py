"""Small fixtures and brute-force versions for the text operators."""
import hashlib
import os
import random

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
SF1 = "/root/testdata/sf0.1"
TABLES = ["documents", "benchmark", "labels", "conversations"]

#: extra columns whose names clash with working columns of the operators
EXTRA = ["ids", "spans", "score", "predicted", "fp", "ws", "m", "h", "gram", "item", "text_hash", "_rest", "root", "parts", "a", "b"]


def docs_frame(spark, rows, extra=True):
    """documents-like frame from (doc_id, text) rows, with clashing columns."""
    cols = EXTRA if extra else []
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint" + "".join(f", `{c}` string" for c in cols)
    data = [(d, t, "en", "s", None if t is None else len(t), *[f"x{c}" for c in cols]) for d, t in rows]
    return spark.createDataFrame(data, schema)


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def edge_texts(seed=3):
    """Texts with all the awkward cases: NULL, empty, spaces only, very long, copies, unusual characters."""
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "delta,", "épsilon", "ÉTA", "ß", "42", "x", "the", "of", "\U0001F600", "a-b"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = prose(60)
    return [None, "", " \t\n", "x", "\n\n\nend\n\n", base, base, base.replace("gamma", "gamme", 1), prose(7), prose(9), prose(10), prose(11),
            prose(30) + "\n" + base[:200] + "\n\n" + prose(5), prose(4000), "y" * 5000, " ".join(["dup"] * 300), "\x00 nul \x0b vt \x0c ff   nbsp   em"]


def duck(sf):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return con


def rows_of(df):
    """Rows as sorted tuples, columns by name."""
    cols = sorted(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def parity(spark, name, sf):
    from panelforge.llm import queries as q
    df = q.QUERIES[name](spark, sf)
    got = df.toPandas()
    want = duck(sf).execute(q.SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    norm = lambda f: sorted(map(repr, f[cols].astype(object).itertuples(index=False, name=None)))
    assert len(got) and norm(got) == norm(want)
