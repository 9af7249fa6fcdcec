"""Registered queries of the operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from shipshape.llm import urls
from shipshape.llm.ann import neighbours
from shipshape.llm.balance import mix
from shipshape.llm.chat import read_back, windows
from shipshape.llm.common import table, written
from shipshape.llm.decontaminate import leaks
from shipshape.llm.jaccard_join import jaccard_components
from shipshape.llm.licences import licences
from shipshape.llm.lines import PASSAGE_WORDS, removed
from shipshape.llm.quality import classify
from shipshape.llm.secrets import scan
from shipshape.llm.spelling import variants
from shipshape.llm.tokens import token_digests
from shipshape.llm.whitening import whiten


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed so that sources weigh 1, 2, 3, repeating."""
    return mix(table(spark, sf_dir, "documents")).withColumn("rows", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).select(
        F.col("id").alias("doc_id"), "size", F.col("class_size").alias("source_size"), "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, models trained from the corpus's own labelled samples."""
    return scan(table(spark, sf_dir, "documents"))


def op3_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts spell control strings, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    hard = turns.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(written(windows(turns.union(hard)))).withColumnRenamed("conv", "conv_id")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item it holds."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines of all documents in runs of 13 words or more, and passages of 50 words or more wherever they stand: what each loses and what it keeps for others, with original offsets."""
    return removed(table(spark, sf_dir, "documents"), words=PASSAGE_WORDS)


def op6_hashing_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest rows of each row whose id is divisible by 100."""
    return neighbours(table(spark, sf_dir, "embeddings"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written and read back."""
    return token_digests(table(spark, sf_dir, "documents"), tokenizer_file())


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all page URLs."""
    return urls.judge(table(spark, sf_dir, "pages"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose distinct 3-word shingles overlap by 90 of 100."""
    return jaccard_components(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt from ``labels.quality``."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words of all documents, their near words, forms and roots."""
    return variants(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings whitened on the eight leading components."""
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents."""
    return licences(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_entropy_mix, op2_secrets, op3_chat_windows, op4_decontaminate, op5_line_dedup, op6_hashing_ann, op7_token_files, op8_url_filter, op9_jaccard_join, op10_quality,
    op11_spelling_variants, op12_embedding_whitening, op13_license_scan)}

#: Queries without a twin: why, and the test that holds them against brute force.
WITHOUT_SQL: dict[str, tuple[str, str]] = {
    "op1_entropy_mix": ("iterated optimisation and hash rounding", "tests/llm/test_operators.py::test_mix_is_near_its_targets_and_repeats"),
    "op2_secrets": ("trained character models", "tests/llm/test_operators.py::test_base_spans_of_the_query_equal_brute_force"),
    "op3_chat_windows": ("windows and escapes read back from formatted text", "tests/llm/test_operators.py::test_chat_windows_read_back"),
    "op4_decontaminate": ("fingerprints of windows", "tests/llm/test_operators.py::test_leaks_with_swapped_parts_are_found"),
    "op5_line_dedup": ("nested spans", "tests/llm/test_operators.py::test_repeated_lines_equal_brute_force"),
    "op6_hashing_ann": ("approximate index", "tests/llm/test_operators.py::test_neighbours_recall"),
    "op7_token_files": ("tokenizer", "tests/llm/test_operators.py::test_special_tokens_are_encoded_as_the_tokenizer_does"),
    "op10_quality": ("trained trees", "tests/llm/test_operators.py::test_quality_separates_held_out_documents"),
    "op12_embedding_whitening": ("eigenvectors", "tests/llm/test_new_operators.py::test_whitening_query_on_given_embeddings"),
    "op13_license_scan": ("nested places of notices", "tests/llm/test_new_operators.py::test_license_query_on_given_documents"),
}

_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urls.RULES)

ORACLE_SQL: dict[str, str] = {
    "op8_url_filter": rf"""
WITH cut AS (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
    SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(verdict, h, p) AS (VALUES {_RULES}),
judged AS (
    SELECT t.page_id, t.host, t.path,
           (SELECT max_by(struct_pack(rule := h || p, verdict := r.verdict), length(h || p)) FROM rules r
            WHERE (t.host = h OR ends_with(t.host, '.' || h)) AND starts_with(t.path, p)) AS best
    FROM parts t)
SELECT page_id, host, path, best.rule AS rule,
       coalesce(best.verdict, CASE WHEN regexp_matches(host || path, '^[^/]*/.*login') OR regexp_matches(host || path, '^[^/]*/.*wp-admin/') OR regexp_matches(host || path, '^[^/]*/.*\.exe$')
                 OR regexp_matches(host || path, '^ads\.[^/]*/') OR regexp_matches(host || path, '^[^/]*\.ads\.[^/]*/')
                THEN 'block' ELSE 'allow' END) AS verdict
FROM judged""",
    "op9_jaccard_join": r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
held AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM held a JOIN held b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, len(s) AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = sets.doc_id) AS component_id FROM sets""",
    "op11_spelling_variants": r"""
WITH RECURSIVE crcs AS (
    SELECT list_transform(range(256), lambda x: list_reduce([x::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
runs AS (
    SELECT doc_id, run, count(*) AS n FROM (
        SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents)
    WHERE length(run) >= 5 GROUP BY ALL),
bytes AS (
    SELECT run, n, flatten(list_transform(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: unicode(c)),
                                          lambda u: CASE WHEN u < 128 THEN [u::BIGINT] ELSE [192 | (u >> 6)::BIGINT, 128 | (u & 63)::BIGINT] END)) AS b FROM runs),
hashed AS (
    SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crcs),
spelt AS (
    SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
vocab AS (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
marks AS (  -- one letter left out, at its place; deletions of the longer word, and common deletions at the same place
    SELECT word, n, i, left(word, i) || substr(word, i + 2) AS cut FROM (SELECT word, n, unnest(range(length(word)))::INT AS i FROM vocab)),
pairs AS (
    SELECT a.word AS a, a.n AS an, b.word AS b, b.n AS bn FROM marks a JOIN marks b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, a.n, b.word, b.n FROM marks a JOIN vocab b ON a.cut = b.word
    UNION SELECT b.word, b.n, a.word, a.n FROM marks a JOIN vocab b ON a.cut = b.word),
near AS (SELECT a, any_value(an) AS an, count(*) AS n_near, arg_min(b, (-bn, encode(b))) AS best, max(bn) AS best_n FROM pairs GROUP BY a),
forms AS (SELECT a AS word, best AS form, best_n AS form_n FROM near WHERE best_n >= 2 * an),
chains(word, last) AS (SELECT word, word FROM vocab UNION ALL SELECT c.word, f.form FROM chains c JOIN forms f ON c.last = f.word),
ends AS (SELECT word, last AS root FROM chains WHERE last NOT IN (SELECT word FROM forms))
SELECT v.word, f.form, e.root, v.n, coalesce(near.n_near, 0) AS n_near, f.form_n
FROM vocab v JOIN ends e USING (word) LEFT JOIN forms f USING (word) LEFT JOIN near ON near.a = v.word""",
}
