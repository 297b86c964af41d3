"""The registered queries of this subpackage: each applies its operator to the whole of its table."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, decontaminate, licenses, line_quality, merkle, near, ngrams, packing, quality, substrings, token_counts, token_files, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op8_quality_rules")
def op8(spark, sf_dir):
    judged = quality.judge(table(spark, sf_dir, "documents")).withColumn("base_failed", quality.base_failed())
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         (~F.col("base_failed") & F.col("good")).alias("kept"), "quality")


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED = r"'[^\x20\x09-\x0D]+'"


@query("op2_decontamination", rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
n AS (SELECT item_id, ws, least(13, len(ws)) AS n FROM i WHERE len(ws) > 0),
w AS (SELECT DISTINCT item_id, n, md5(array_to_string(ws[k:k + n - 1], ' ')) AS h FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS k FROM n)),
s AS (SELECT DISTINCT n FROM w),
g AS (SELECT row, k, n, md5(array_to_string(ws[k:k + n - 1], ' ')) AS h FROM (SELECT row, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, s WHERE len(ws) >= n)),
hits AS (SELECT row, k, g.n, item_id FROM g JOIN w ON w.h = g.h AND w.n = g.n),
c AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT row, k, n FROM hits)) GROUP BY 1),
m AS (SELECT row, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM (SELECT DISTINCT row, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN c USING (row) LEFT JOIN m USING (row)""")
def op2(spark, sf_dir):
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.concat_ws(",", F.sort_array(F.transform("items", lambda i: i.cast("string"))))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), "contaminated")


@query("op10_lm_scoring")
def op10(spark, sf_dir):
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    return ngrams.score(table(spark, sf_dir, "documents"), fold != 2)


@query("op5_substring_dedup", rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), {SPACED}) AS ws FROM documents),
g AS (SELECT row, k, md5(array_to_string(ws[k:k + 34], ' ')) AS h FROM (SELECT row, ws, unnest(range(1, len(ws) - 33)) AS k FROM d WHERE len(ws) >= 35)),
r AS (SELECT row, k FROM g JOIN (SELECT h FROM g GROUP BY 1 HAVING count(*) > 1) x USING (h)),
c AS (SELECT DISTINCT row, unnest(range(k, k + 35)) AS p FROM r),
gone AS (SELECT row, count(*) AS n_removed FROM c GROUP BY 1),
kept AS (SELECT u.row, string_agg(word, ' ' ORDER BY u.p) AS text FROM (SELECT row, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d) u
  LEFT JOIN c ON c.row = u.row AND c.p = u.p WHERE c.p IS NULL GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (row) LEFT JOIN kept USING (row)""")
def op5(spark, sf_dir):
    found = substrings.repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op7_near_dedup", rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({LOWERED}, {SPACED}) AS ws FROM documents),
s AS (SELECT DISTINCT row, md5(array_to_string(ws[k:k + 2], ' ')) AS g FROM (SELECT row, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS k FROM d WHERE len(ws) > 0)),
z AS (SELECT row, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.row AS x, b.row AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.row <> b.row GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN z a ON a.row = x JOIN z b ON b.row = y WHERE 100 * shared >= 85 * (a.n + b.n - shared)),
r AS (SELECT row AS x, row AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
c AS (SELECT r.x AS row, min(d.doc_id) AS component_id FROM r JOIN d ON d.row = r.y GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM d JOIN c USING (row) LEFT JOIN z USING (row)""")
def op7(spark, sf_dir):
    return near.near_duplicates(table(spark, sf_dir, "documents")).drop("row_key")


@query("op4_best_fit_packing")
def op4(spark, sf_dir):
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


@query("op9_token_files")
def op9(spark, sf_dir):
    folder = token_files.folder(spark)
    token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return token_files.read(spark, folder)


MARKER = "</s>[INST] ok [/INST]"


@query("op3_chat_formatting", r"""
WITH rows AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(role) + length(replace(replace(text, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|')) + 13) AS BIGINT) AS formatted_chars,
       CAST(count(*) FILTER (role = 'assistant') AS BIGINT) AS n_examples
FROM rows GROUP BY conv_id""")
def op3(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", MARKER), (-1, 1, "assistant", MARKER)], "conv_id bigint, turn bigint, role string, text string")
    made = chat.segments(rows.unionByName(more))
    return chat.digest(made, chat.examples(made))


@query("op1_token_counts")
def op1(spark, sf_dir):
    return token_counts.count(table(spark, sf_dir, "documents"), token_counts.vocabulary(public_tokenizers.path("piece_bpe_32k.model")))


def _canonical_sql(text: str, lines: bool = False) -> str:
    """licenses.canonical for an engine without looks ahead: each line by itself is judged a statement of copyright or not."""
    sign, (words, the) = r"^[^\p{L}\p{N}]*(copyright|\(c\)|©)", licenses.PROSE.split(r"|the\b(?!.*")
    after = rf"{sign}[^\p{{L}}\p{{N}}]*"
    stated = (rf"regexp_matches(l, '{sign}[ \t(]') AND NOT regexp_matches(l, '{after}(({words})\b|$)')"
              rf" AND (NOT regexp_matches(l, '{after}the\b') OR regexp_matches(l, '{after}the\b.*{the[:-1]}'))")
    sql = f"string_split(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(10))"
    sql = f"array_to_string(list_transform({sql}, lambda l: CASE WHEN {stated} THEN '' ELSE l END), chr(10))"
    sql = rf"regexp_replace({sql}, '[^\p{{L}}\p{{N}}{chr(92) + 'n' if lines else ''}]+', ' ', 'g')"
    for one, other in licenses.SPELLINGS:
        if other.replace("/", " ") != one:
            sql = f"replace({sql}, '{other.replace('/', ' ')}', '{one}')"
    return sql


def _rows_sql(rows) -> str:
    return "(VALUES " + ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in rows) + ")"


def _digests_sql(rows: str) -> str:
    return f"(SELECT sha256(trim({_canonical_sql('text')})) AS digest, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM {rows} GROUP BY 1)"


#: Known texts without titles, so that each stands in the SQL once; titles are put above them there.
BARE = [(name, text) for name, text in licenses.known_texts() if not any(text.startswith(f"{t}\n\n") for t in licenses.TITLES.get(name, ()))]
TITLED = [(name, title) for name, titles in licenses.TITLES.items() for title in titles]


@query("op6_license_scan", f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS row, text FROM documents),
bare AS (SELECT * FROM {_rows_sql(BARE)} t(name, text)),
whole AS (SELECT * FROM bare UNION ALL SELECT name, title || chr(10) || chr(10) || text FROM bare JOIN {_rows_sql(TITLED)} t(name, title) USING (name)),
lines AS (SELECT row, unnest(string_split({_canonical_sql('text', True)}, chr(10))) AS line FROM docs),
found AS (SELECT row, string_agg(DISTINCT names, ',' ORDER BY names) AS notices FROM lines JOIN {_digests_sql(_rows_sql(licenses.known_notices()) + " t(name, text)")} k ON sha256(trim(line)) = digest GROUP BY row)
SELECT doc_id, text_sha256, names AS license, coalesce(notices, '') AS notices
FROM (SELECT row, doc_id, sha256(trim({_canonical_sql('text')})) AS text_sha256 FROM docs) d
LEFT JOIN {_digests_sql("whole")} k ON text_sha256 = digest LEFT JOIN found USING (row)""")
def op6(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


MANIFEST = ("doc_id", "source", "lang", "n_chars", "text")


def _leaf_sql(text: str) -> str:
    parts = [f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in (text if c == "text" else f"CAST({c} AS VARCHAR)" for c in MANIFEST)]
    return f"sha256({' || '.join(parts)})"


def _tree_sql(name: str, first: str, levels: int) -> str:
    """Runs of eight over (g, i, d, n), level by level: name_r0, name_r1, ... with the digests of each run. 8**levels nodes at most."""
    out = [f"{name}_n0 AS ({first})"]
    for k in range(levels):
        out.append(f"{name}_r{k} AS MATERIALIZED (SELECT g, i // 8 AS q, list(d ORDER BY i) AS ds, any_value(n) AS n FROM {name}_n{k} GROUP BY 1, 2)")
        out.append(f"{name}_n{k + 1} AS (SELECT g, q AS i, CASE WHEN n > 1 THEN sha256(array_to_string(ds, '')) ELSE ds[1] END AS d, (n + 7) // 8 AS n FROM {name}_r{k})")
    return ",\n".join(out)


def _fold_sql(name: str, tree: str, frm: str, group: str, place: str, levels: int) -> list[str]:
    """Each level's siblings go to the proof and around the folded digest."""
    out = []
    for k in range(levels):
        before, after = f"array_to_string(r.ds[1:({place} // {8 ** k}) % 8], '')", f"array_to_string(r.ds[({place} // {8 ** k}) % 8 + 2:], '')"
        out.append(f"{name}_f{k} AS (SELECT p.* EXCLUDE (folded, proof), CASE WHEN r.n > 1 THEN sha256({before} || p.folded || {after}) ELSE p.folded END AS folded,"
                   f" CASE WHEN r.n > 1 THEN p.proof || {before} || {after} ELSE p.proof END AS proof"
                   f" FROM {frm} p JOIN {tree}_r{k} r ON r.g IS NOT DISTINCT FROM {group} AND r.q = {place} // {8 ** (k + 1)})")
        frm = f"{name}_f{k}"
    return out


#: The crc32 of a decimal number, bit by bit: a byte goes in, then eight shifts (-1).
CRC_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295)"""


@query("op12_merkle_manifest", f"""
WITH l AS (SELECT doc_id, lang, {_leaf_sql('text')} AS leaf,
  CASE WHEN {CRC_SQL} % 3 = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS other FROM documents),
p AS MATERIALIZED (SELECT doc_id, lang, leaf, coalesce(other, leaf) AS folded, '' AS proof, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM l),
{_tree_sql("a", "SELECT lang AS g, place AS i, leaf AS d, count(*) OVER (PARTITION BY lang) AS n FROM p", 8)},
s AS (SELECT g AS lang, d AS subroot, row_number() OVER (ORDER BY encode(g) NULLS FIRST) - 1 AS spot FROM a_n8),
{_tree_sql("b", "SELECT 0 AS g, spot AS i, subroot AS d, count(*) OVER () AS n FROM s", 4)},
{", ".join(_fold_sql("x", "a", "p", "p.lang", "p.place", 8))},
w AS (SELECT x_f7.*, subroot, spot FROM x_f7 JOIN s ON s.lang IS NOT DISTINCT FROM x_f7.lang),
{", ".join(_fold_sql("y", "b", "w", "0", "p.spot", 4))}
SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = d AS verified FROM y_f3, b_n4""")
def op12(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    other = F.when(third, merkle.leaf({c: lowered if c == "text" else F.col(c) for c in MANIFEST}))
    return merkle.manifest(docs, MANIFEST, "lang", "doc_id", other)


@query("op13_embedding_whitening")
def op13(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8)


@query("op11_quality_classifier")
def op11(spark, sf_dir):
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    scored = line_quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
