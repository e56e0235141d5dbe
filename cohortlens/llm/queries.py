"""The thin queries of the numbered operators, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import decontamination, langid, linededup, lmscore, media, merkle, neardup, packing, shards, tokencount, toxicity, variants, wrappers
from cohortlens.llm.common import read, remainder


def op1_tiered_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.placement(shards.compacted(read(spark, sf_dir, "documents")))


def op2_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = remainder(F.col("doc_id"), toxicity.FOLDS) == toxicity.HELD_OUT
    scored = toxicity.toxicity(docs, toxicity.train(docs, labels.where(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(read(spark, sf_dir, "documents")))


def op3_iso_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(media.stored_as_media(read(spark, sf_dir, "documents")))


def op4_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_texts(read(spark, sf_dir, "pages"))


def op7_winnowing_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "removed.*")


def op8_viterbi_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(read(spark, sf_dir, "documents"))


def op9_odd_sketch_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(read(spark, sf_dir, "documents"), words=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op10_ftrl_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.train(docs.where(langid.learnable())))
    held_out = remainder(F.col("doc_id"), langid.FOLDS) == langid.HELD_OUT
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def tampered() -> Column:
    """Of which rows the text is tampered with in operator 11."""
    return F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), 3) == 0)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.Manifest(merkle.leaves_of(read(spark, sf_dir, "documents"), tampered())).verified("claimed")


def op12_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder(F.col("doc_id"), 7) == 2
    found = lmscore.score(read(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", (~F.col("learnt")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = variants.variants(variants.vocabulary(read(spark, sf_dir, "documents")))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_tiered_sharding, op2_counterfactual_toxicity, op3_iso_media_columns, op4_fm_decontamination, op5_mixture_packing,
        op6_wrapper_text, op7_winnowing_line_dedup, op8_viterbi_token_counts, op9_odd_sketch_neardup, op10_ftrl_language_id,
        op11_merkle_manifest, op12_elias_fano_lm, op13_spelling_variants,
    )
    return {f.__name__: f for f in found}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Every window of every item, looked up at every place of every document.
OP4_SQL = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 i AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
 at_item AS (SELECT item_id, w, least(len(w), {decontamination.WINDOW}) AS k, unnest(range(1, len(w) - least(len(w), {decontamination.WINDOW}) + 2)) AS p FROM i WHERE len(w) > 0),
 windows AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS phrase FROM at_item),
 at_doc AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k),
 places AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS phrase FROM at_doc),
 hits AS (SELECT doc_id, item_id, k, p FROM places JOIN windows USING (k, phrase)),
 words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hits) GROUP BY 1),
 items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
 SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

#: Every pair of documents that share a shingle, counted in full, and all that can be reached over links.
OP9_SQL = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
 at_doc AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS p FROM d WHERE len(w) > 0),
 sets AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 2], ' ') AS shingle FROM at_doc),
 sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
 common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
 links AS (SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
 sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
 reached AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT reached.doc_id, y FROM reached JOIN sides ON x = other)
 SELECT d.doc_id, coalesce(max(n), 0) AS n_shingles, min(other) AS component_id, d.doc_id = min(other) AS kept FROM d LEFT JOIN sizes ON sizes.doc_id = d.doc_id JOIN reached ON reached.doc_id = d.doc_id GROUP BY d.doc_id"""


#: crc32 in two steps: the table of its 256 remainders, and the unsigned value of a text's UTF-8 bytes.
_CRC_TABLE = "crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY i) AS t FROM range(256) r(i))"


def _crc32(text: str) -> str:
    """A DuckDB expression, to be used beside a row of ``crc``."""
    codes = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda p: CAST('0x' || substr(hex(encode({text})), CAST(2 * p - 1 AS BIGINT), 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: xor(c >> 8, t[CAST(xor(c & 255, b) AS BIGINT) + 1])), 4294967295)"


#: Every pair of near words, by the deletions and by the words with one place left open that they share.
OP13_SQL = rf"""WITH RECURSIVE {_CRC_TABLE},
 at_doc AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
 runs AS (SELECT doc_id, run, count(*) AS n FROM at_doc GROUP BY 1, 2),
 hashed AS (SELECT run, n, {_crc32("CAST(doc_id AS VARCHAR) || ':' || run")} AS h FROM runs, crc),
 made AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM hashed),
 words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM made GROUP BY 1 HAVING length(word) >= {variants.MIN_LENGTH} AND sum(n) >= {variants.MIN_COUNT}),
 places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words),
 holes AS (SELECT word, n, left(word, p - 1) || '?' || substr(word, p + 1) AS k FROM places),
 shorter AS (SELECT DISTINCT word, n, left(word, p - 1) || substr(word, p + 1) AS k FROM places),
 near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM holes a JOIN holes b ON a.k = b.k AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM shorter a JOIN words b ON a.k = b.word UNION SELECT b.word, a.word, a.n FROM shorter a JOIN words b ON a.k = b.word),
 best AS (SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) = 1),
 found AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {variants.RATIO} * n THEN other END AS form, CASE WHEN other_n >= {variants.RATIO} * n THEN other_n END AS form_n FROM words w LEFT JOIN best USING (word)),
 led AS (SELECT word, word AS root, form AS onward FROM found UNION ALL SELECT led.word, f.word, f.form FROM led JOIN found f ON led.onward = f.word)
 SELECT f.word, f.form, led.root, f.n, f.n_near, f.form_n FROM found f JOIN led ON led.word = f.word WHERE led.onward IS NULL"""


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR) END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _up(name: str) -> str:
    """The nodes above the leaves ``name`` (tree, idx, n, digest)."""
    return f"""{name}_up AS (SELECT tree, 0 AS level, idx, n, digest FROM {name}
  UNION ALL SELECT tree, level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM {name}_up WHERE n > 1 GROUP BY tree, level, idx // 8, n)"""


def _proofs(name: str, nodes: str) -> str:
    """For each of ``name`` (tree, id, idx, n, claimed) the claim folded up the tree, and the siblings on that way."""
    return f"""{name}_fold AS (SELECT tree, id, 0 AS level, idx, n, claimed AS digest FROM {name}
  UNION ALL SELECT f.tree, f.id, f.level + 1, f.idx // 8, (f.n + 7) // 8, sha256(string_agg(CASE WHEN s.idx = f.idx THEN f.digest ELSE s.digest END, '' ORDER BY s.idx))
   FROM {name}_fold f JOIN {nodes} s ON s.tree IS NOT DISTINCT FROM f.tree AND s.level = f.level AND s.idx // 8 = f.idx // 8 WHERE f.n > 1 GROUP BY f.tree, f.id, f.level, f.idx, f.n),
 {name}_others AS (SELECT l.tree, l.id, string_agg(s.digest, '' ORDER BY s.level, s.idx) AS others FROM {name} l JOIN {nodes} s ON s.tree IS NOT DISTINCT FROM l.tree
   AND s.n > 1 AND s.idx // 8 = l.idx // CAST(8 ** (s.level + 1) AS BIGINT) AND s.idx <> l.idx // CAST(8 ** s.level AS BIGINT) GROUP BY l.tree, l.id)"""


#: Each leaf's claim is folded up by itself; the subroots' tree is folded for each leaf's subroot.
OP11_SQL = rf"""WITH RECURSIVE {_CRC_TABLE},
 rows_ AS (SELECT *, {_leaf("text")} AS digest, CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf("text")} END AS claimed FROM documents, crc),
 a AS (SELECT lang AS tree, doc_id AS id, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n, digest, claimed FROM rows_),
 {_up("a")},
 {_proofs("a", "a_up")},
 subroots AS (SELECT tree, digest, row_number() OVER (ORDER BY encode(tree) NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM a_up WHERE n = 1),
 b AS (SELECT 0 AS tree, a.id, s.idx, s.n, s.digest, f.digest AS claimed FROM a JOIN a_fold f ON f.n = 1 AND f.id = a.id JOIN subroots s ON s.tree IS NOT DISTINCT FROM a.tree),
 c AS (SELECT DISTINCT 0 AS tree, idx, n, digest FROM b),
 {_up("c")},
 {_proofs("b", "c_up")}
 SELECT a.id AS doc_id, a.digest AS leaf, b.digest AS subroot, r.digest AS root, sha256(coalesce(ao.others, '') || coalesce(bo.others, '')) AS proof_sha256, bf.digest AS folded_root, bf.digest = r.digest AS verified
 FROM a JOIN b ON b.id = a.id JOIN b_fold bf ON bf.id = a.id AND bf.n = 1 JOIN c_up r ON r.n = 1 LEFT JOIN a_others ao ON ao.id = a.id LEFT JOIN b_others bo ON bo.id = a.id"""


def oracle_sql() -> dict[str, str]:
    return {"op4_fm_decontamination": OP4_SQL, "op9_odd_sketch_neardup": OP9_SQL, "op11_merkle_manifest": OP11_SQL, "op13_spelling_variants": OP13_SQL}
