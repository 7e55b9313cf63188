"""Registered queries of the text operators: ``opN_<name>`` builders
``(spark, sf_dir) -> DataFrame`` over the whole table, and DuckDB SQL where SQL
can express the result."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_multi_50k.tiktoken"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op2_byte_bpe(spark, sf_dir):
    import public_tokenizers

    from .bpe import encode_documents
    return encode_documents(spark, table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


@query
def op6_chat_format(spark, sf_dir):
    from .chat import format_conversations, read_back, text_parts
    said = "</s>[INST] ok [/INST]"
    convs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], convs.schema)
    return read_back(format_conversations(text_parts(convs.unionByName(extra))))


SQL["op6_chat_format"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
    sum(13 + length(regexp_replace(role, '([\\<\[])', '\\\1', 'g')) + length(regexp_replace(text, '([\\<\[])', '\\\1', 'g'))) AS formatted_chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""


@query
def op7_secret_scan(spark, sf_dir):
    from .secrets import digest, find_secrets
    return digest(find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))


@query
def op1_decontaminate(spark, sf_dir):
    from .decontam import contamination, digest
    return digest(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


_WORDS = r"""list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""
SQL["op1_decontaminate"] = rf"""
WITH b AS (SELECT item_id, ws, least(len(ws), 10) AS l FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, l, array_to_string(ws[i + 1:i + l], ' ') AS gram
       FROM (SELECT *, unnest(range(len(ws) - l + 1)) AS i FROM b)),
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
dw AS (SELECT doc_id, i, l, array_to_string(ws[i + 1:i + l], ' ') AS gram
       FROM (SELECT doc_id, ws, l, unnest(range(greatest(0, len(ws) - l + 1))) AS i FROM d, (SELECT DISTINCT l FROM bw))),
h AS (SELECT doc_id, i, l, item_id FROM dw JOIN bw USING (l, gram)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM (SELECT DISTINCT doc_id, i, l FROM h)) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""


@query
def op9_merkle(spark, sf_dir):
    from .merkle import fingerprints_and_edits
    return fingerprints_and_edits(table(spark, sf_dir, "documents"))


def _fingerprint_sql(text: str) -> str:
    """Every level is a list of {n: whole node, s: as written}; a parent hashes its children's n."""
    def parent(kind, children, digits, mark, between):
        part = lambda f: f"array_to_string(list_transform(cs, lambda c: c.{f}), '{between}')"
        return (f"list_transform(list_transform([{children}], lambda cs: {{'h': sha256('{kind}' || {part('n')}), 't': {part('s')}}}), "
                f"lambda v: {{'n': v.h, 's': substr(v.h, 1, {digits}) || '{mark}' || v.t}})[1]")
    leaf = r"list_transform(list_transform(regexp_extract_all(p, '[^\n]{1,32}\n*|\n+'), lambda x: sha256('L' || x)), lambda h: {'n': h, 's': substr(h, 1, 8)})"
    pars = rf"list_transform(regexp_extract_all({text}, '[^\n]*\n+|[^\n]+'), lambda p: {parent('P', leaf, 8, '.', '.')})"
    secs = f"list_transform([{pars}], lambda ps: list_transform(range(1, len(ps) + 1, 8), lambda i: {parent('S', 'ps[i:i + 7]', 16, ':', ';')}))[1]"
    return f"({parent('R', secs, 64, '|', '|')}).s"


def _likeness_sql(a: str, b: str) -> str:
    leaves = lambda x: rf"list_distinct(regexp_extract_all({x}, '\.([0-9a-f]{{8}})', 1))"
    x, y = leaves(a), leaves(b)
    return f"CASE WHEN len({x}) + len({y}) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({x}, {y})) / (len({x}) + len({y})) END"


SQL["op9_merkle"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS (SELECT *, {_fingerprint_sql('text')} AS fp FROM d),
n AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS nt, coalesce(lead(fp) OVER w, first_value(fp) OVER w) AS nf
      FROM f WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, text)),
e AS (SELECT *, length(text) AS n_chars,
      left(text, length(text) - length(text) // 3) || left(nt, length(text) // 3) AS edited FROM n),
g AS (SELECT *, {_fingerprint_sql('edited')} AS ef FROM e)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, fp AS fingerprint, ef AS edited_fingerprint,
  {_likeness_sql('fp', 'ef')} AS near_edited, {_likeness_sql('fp', 'nf')} AS near_next FROM g
"""


@query
def op4_simhash(spark, sf_dir):
    from .simhash import digest, near_duplicates
    return digest(near_duplicates(table(spark, sf_dir, "documents"), shingle=4, distance=4))


@query
def op8_toxicity(spark, sf_dir):
    from .toxicity import classify, digest, fit
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(classify(docs, fit(docs, table(spark, sf_dir, "labels"))).drop("text"))


@query
def op10_quality(spark, sf_dir):
    from .quality import classify, digest, fit
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(classify(docs, fit(docs, table(spark, sf_dir, "labels"))).drop("text"))


@query
def op3_maxent_lm(spark, sf_dir):
    from .lm import score, train
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, *train(docs))


@query
def op5_surrogates(spark, sf_dir):
    from .pii import replace_entities
    found = replace_entities(table(spark, sf_dir, "documents"), key="corpus")
    spans = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    return found.select("doc_id", "text", "n_entities", spans.alias("spans"))


@query
def op13_alignment(spark, sf_dir):
    import public_tokenizers

    from .align import align, sha256_or_empty, weigh
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return weigh(align(docs, *paths, render=sha256_or_empty)).withColumnRenamed("groups", "groups_sha256")


@query
def op12_manifest(spark, sf_dir):
    from .manifest import manifest, verify
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return verify(manifest(docs, {"n_chars": F.col("n_chars") + F.when(tampered, 1).otherwise(0)}))


_leaf_sql = lambda n_chars: "sha256(" + " || ".join(
    f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END" for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"
# CRC-32 by its bits: 8 steps a byte of the decimal doc_id
_CRC = """xor(4294967295, list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))))"""
_LEVEL_UP = "list_transform(range((len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))"
_STEPS = """SELECT doc_id, leaf, k, {level} AS level, nodes[xor(r >> level, 1) + 1] AS sibling,
  CASE WHEN nodes[xor(r >> level, 1) + 1] IS NULL THEN 'N' WHEN (r >> level) & 1 = 0 THEN 'L' ELSE 'R' END AS side FROM {rows} WHERE len(nodes) > 1"""
SQL["op12_manifest"] = f"""
WITH RECURSIVE d AS (
  SELECT *, CASE WHEN doc_id IS NOT NULL AND {_CRC} % 7 = 0 THEN {_leaf_sql('(n_chars + 1)')} ELSE leaf END AS other
  FROM (SELECT *, {_leaf_sql('n_chars')} AS leaf, coalesce('=' || lang, '-') AS g FROM documents)),
r AS (SELECT doc_id, g, leaf, other, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, row_number() OVER () AS k FROM d),
lv AS (SELECT g, 0 AS level, list(leaf ORDER BY r) AS nodes FROM r GROUP BY g
       UNION ALL SELECT g, level + 1, {_LEVEL_UP} FROM lv WHERE len(nodes) > 1),
sub AS (SELECT g, nodes[1] AS subroot, row_number() OVER (ORDER BY g) - 1 AS r FROM lv WHERE len(nodes) = 1),
tv AS (SELECT 0 AS level, list(subroot ORDER BY r) AS nodes FROM sub
       UNION ALL SELECT level + 1, {_LEVEL_UP} FROM tv WHERE len(nodes) > 1),
s AS ({_STEPS.format(level='level', rows='r JOIN lv USING (g)')}
      UNION ALL {_STEPS.format(level='1000 + level', rows='(SELECT r.doc_id, r.leaf, r.k, sub.r FROM r JOIN sub USING (g)), tv')}),
p AS (SELECT k, string_agg(sibling, '' ORDER BY level) AS proof, list(side || coalesce(sibling, '') ORDER BY level) AS steps FROM s GROUP BY k),
f AS (SELECT r.doc_id, r.leaf, subroot, (SELECT nodes[1] FROM tv WHERE len(nodes) = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
  list_reduce([other] || coalesce(steps, []), lambda a, x: sha256(CASE x[1] WHEN 'L' THEN a || x[2:] WHEN 'R' THEN x[2:] || a ELSE a END)) AS folded_root
  FROM r JOIN sub USING (g) LEFT JOIN p USING (k))
SELECT *, folded_root = root AS verified FROM f
"""


@query
def op11_suffix_dedup(spark, sf_dir):
    from .suffix import digest, remove_repeats
    return digest(remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))
