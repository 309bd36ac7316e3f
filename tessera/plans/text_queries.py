"""Text queries over the documents and over a few clinical notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as lex
from ..operators import text as tx
from ..session import spread, stored, table
from .fixtures import NOTES_SQL, notes


def _docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _per_doc(make):
    return lambda spark, sf_dir: _docs(spark, sf_dir).select("doc_id", *make(F.col("text")))


def _digest(tokens):
    """Number and digest of a list of tokens."""
    return [F.size(tokens).cast("long").alias("n_tokens"), F.md5(F.array_join(tokens, " ")).alias("tokens_md5")]


def profiles(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return docs.select("doc_id", *[F.md5(tx.clean_text(F.col("text"), p.cleaning)).alias(name) for name, p in tx.PROFILES.items()])


def stopword_anti(spark, sf_dir):
    """Counts of the words that are not stop words, by an anti join."""
    words = _docs(spark, sf_dir).select(F.explode(tx.bag_tokenize(F.col("text"))).alias("term"))
    stop = spark.createDataFrame([(w,) for w in lex.STOP_WORDS], "term string")
    return words.groupBy("term").agg(F.count("*").alias("n")).join(F.broadcast(stop), "term", "left_anti")  # a fixed list


def _tokens():
    return tx.tokenize(F.col("text"))


def vocab(spark, sf_dir):
    return tx.vocabulary(_docs(spark, sf_dir), _tokens(), 1000, 2)


def sequences(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    out = tx.sequences(docs, "doc_id", _tokens(), tx.vocabulary(docs, _tokens(), 1000, 2), 64)
    return out.select("doc_id", F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"))


def ngrams(spark, sf_dir):
    return tx.ngram_counts(_docs(spark, sf_dir))


def stats(spark, sf_dir):
    out = _docs(spark, sf_dir).select("doc_id", tx.text_statistics(F.col("text")).alias("s")).select("doc_id", "s.*")
    return out.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("token_count", "sentence_count", "word_count")], *[F.round(c, 6).alias(c) for c in ("avg_word_length", "avg_sentence_length", "clinical_keyword_density")])


def _weights(df):
    return df.select("doc_id", "id", F.round("v", 6).alias("v"))


def tfidf_batch(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    counts = stored(tx.term_counts(docs, "doc_id", _tokens()))
    return _weights(tx.tfidf_of(counts, docs.count(), "doc_id", tx.vocabulary_of(counts, 200, 2)))


def tfidf_fitted(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    words = tx.model_tokenize(F.col("text"))
    return _weights(tx.vectorize(docs, "doc_id", words, tx.model_vocabulary(docs, "doc_id", words, 200)))


def bow(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return _weights(tx.bag_of_words(docs, "doc_id", tx.bag_vocabulary(docs, 200)))


def model_vocab(spark, sf_dir):
    return tx.model_vocabulary(_docs(spark, sf_dir), "doc_id", tx.model_tokenize(F.col("text")), 1000).select("term", "id", "df", F.round("idf", 6).alias("idf"))


def keywords(spark, sf_dir):
    return tx.keyword_counts(notes(spark), "note_id", _tokens())


def model_keywords(spark, sf_dir):
    return tx.keyword_counts(notes(spark), "note_id", tx.model_tokenize(F.col("text")), lex.MODEL_KEYWORDS)


def keywords_semi(spark, sf_dir):
    """Document words that are keywords, by a semi join."""
    words = _docs(spark, sf_dir).select("doc_id", F.explode(_tokens()).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    keys = spark.createDataFrame([(w,) for w in sorted({*lex.CLINICAL_KEYWORDS, *lex.MODEL_KEYWORDS, *lex.SYMPTOM_WORDS})], "term string")
    return words.join(F.broadcast(keys), "term", "left_semi").select("doc_id", "term", "n")  # a fixed list


def _entities(expand):
    def run(spark, sf_dir):
        tokens = tx.tokenize(F.col("text"), tx.CleaningConfig(expand_abbreviations=expand))
        e = tx.entities(F.col("tokens"))
        out = notes(spark).select("note_id", tokens.alias("tokens")).select("note_id", e.alias("e")).select("note_id", "e.*")
        return out.select("note_id", *[F.array_join(c, "|").alias(c) for c in ("medications", "symptoms", "vital_signs")])

    return run


def _fitted(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return docs, tx.TextPreprocessor(tx.TextConfig(max_features=200, max_length=64)).fit(docs)


def fit_transform(spark, sf_dir):
    docs, model = _fitted(spark, sf_dir)
    return _weights(model.transform(docs))


def fit_sequences(spark, sf_dir):
    docs, model = _fitted(spark, sf_dir)
    return model.sequences(docs).select("doc_id", F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"))


#: Words of the documents, which hold no clinical ones.
_COMMON = ("and", "that", "under", "licensed", "this", "license", "work", "que", "les")


def docs_entities(spark, sf_dir):
    e = _docs(spark, sf_dir).select("doc_id", _tokens().alias("tokens")).select("doc_id", tx.entities(F.col("tokens")).alias("e")).select("doc_id", "e.*")
    return e.select("doc_id", *[F.array_join(c, "|").alias(c) for c in ("medications", "symptoms", "vital_signs")])


QUERIES = {
    "txt_clean": _per_doc(lambda t: [F.md5(tx.clean_text(t)).alias("clean_md5"), F.length(tx.clean_text(t)).cast("long").alias("n_chars")]),
    "txt_clean_profiles": profiles,
    "txt_expand_abbrev": _per_doc(lambda t: [F.md5(tx.expand_abbreviations(F.lower(t))).alias("text_md5")]),
    "txt_notes_clean": lambda spark, sf_dir: notes(spark).select("note_id", tx.clean_text(F.col("text")).alias("clean"), tx.remove_numbers(F.col("text")).alias("no_numbers")),
    "txt_tokenize": _per_doc(lambda t: _digest(tx.tokenize(t))),
    "txt_model_tokenize": _per_doc(lambda t: _digest(tx.model_tokenize(t))),
    "txt_stopword_anti": stopword_anti,
    "txt_vocab": vocab,
    "txt_sequences": sequences,
    "txt_ngrams": ngrams,
    "txt_stats": stats,
    "txt_tfidf_batch": tfidf_batch,
    "txt_tfidf_fitted": tfidf_fitted,
    "txt_bow": bow,
    "txt_model_vocab": model_vocab,
    "txt_keywords": keywords,
    "txt_model_keywords": model_keywords,
    "txt_keywords_semi": keywords_semi,
    "txt_entities_expanded": _entities(True),
    "txt_entities_raw": _entities(False),
    "txt_fit_transform": fit_transform,
    "txt_fit_sequences": fit_sequences,
    "txt_docs_keywords": lambda spark, sf_dir: tx.keyword_counts(_docs(spark, sf_dir), "doc_id", _tokens(), _COMMON),
    "txt_docs_entities": docs_entities,
}

_IN = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in lex.ABBREVIATIONS.items() if k.isalnum()) + "}"
_NV = r"regexp_replace({t}, '(^|[^\p{{L}}\p{{M}}\p{{N}}_])n/v($|[^\p{{L}}\p{{M}}\p{{N}}_])', '\1nausea and vomiting\2', 'g')"


def _expand(t):
    return f"array_to_string(list_transform(regexp_extract_all({_NV.format(t=t)}, '([\\p{{L}}\\p{{M}}\\p{{N}}_]+|[^\\p{{L}}\\p{{M}}\\p{{N}}_]+)'), lambda r: coalesce({_MAP}[r], r)), '')"


def _special(t):
    return rf"regexp_replace({t}, '[^\p{{L}}\p{{M}}\p{{N}}\s.,;:/\-+%><=]', '', 'g')"


def _punct(t):
    return "regexp_replace(" + t + r""", '[!"#$&''()*,.:;?@\[\\\]^_`{|}~]', '', 'g')"""


def _space(t):
    return rf"trim(regexp_replace({t}, '\s+', ' ', 'g'))"


def _clean(t="text", special=True, punct=True, expand=True):
    t = f"lower({t})"
    t = _expand(t) if expand else t
    t = _special(t) if special else t
    t = _punct(t) if punct else t
    return _space(t)


def _toks(t="text", **how):
    return f"list_filter(string_split({_clean(t, **how)}, ' '), lambda w: strlen(w) > 1 AND w NOT IN {_IN(lex.STOP_WORDS)})"


def _mtoks(t="text"):
    return rf"list_filter(list_transform(string_split({_space(f'lower({t})')}, ' '), lambda w: regexp_replace(w, '[^\p{{L}}\p{{M}}\p{{N}}]', '', 'g')), lambda w: strlen(w) > 2 AND w NOT IN {_IN(lex.MODEL_STOP_WORDS)})"


def _btoks(t="text"):
    return f"list_filter(string_split({_space(f'lower({t})')}, ' '), lambda w: w <> '')"


_D = f"WITH d AS (SELECT doc_id, text, {_toks()} AS ws FROM documents)"
_VOC = "voc AS (SELECT term, n, (row_number() OVER (ORDER BY n DESC, term) + 1)::INT AS id FROM (SELECT term, count(*) AS n FROM (SELECT unnest(ws) AS term FROM d) GROUP BY 1 HAVING count(*) >= 2) QUALIFY id <= {take} + 1)"
_M = f"WITH d AS (SELECT doc_id, {_mtoks()} AS ws FROM documents)"
_MVOC = f"""voc AS (SELECT term, df, (row_number() OVER (ORDER BY (term IN {_IN(lex.MODEL_KEYWORDS)})::INT DESC, df DESC, term) - 1)::INT AS id, ln((SELECT count(*) FROM d) * 1e0 / df) AS idf
  FROM (SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(ws)) AS term FROM d) GROUP BY 1) QUALIFY id < {{take}})"""
_TC = "tc AS (SELECT r, doc_id, total, term, count(*) AS n FROM (SELECT r, doc_id, len(ws) AS total, unnest(ws) AS term FROM (SELECT row_number() OVER () AS r, * FROM d)) GROUP BY ALL)"
_N = f"WITH n AS ({NOTES_SQL})"


def _prof(p):
    return f"md5({_clean(special=False, punct=p.cleaning.remove_punctuation)})"


def _ents(expand, source=NOTES_SQL):
    """The fold as recursion: one token a step, unless a medication was taken."""
    return f"""WITH RECURSIVE n AS ({source}), k AS (SELECT note_id, {_toks(expand=expand)} AS ws FROM n),
walk AS (
  SELECT note_id, ws, 1 AS i, NULL::VARCHAR AS med, NULL::VARCHAR AS sym, NULL::VARCHAR AS vit FROM k
  UNION ALL
  SELECT note_id, ws, CASE WHEN m THEN i + 2 ELSE i + 1 END, CASE WHEN m THEN ws[i + 1] END, CASE WHEN NOT m AND ws[i] IN {_IN(lex.SYMPTOM_WORDS)} THEN ws[i] END,
    CASE WHEN NOT m AND ws[i] IN {_IN(lex.VITAL_WORDS)} AND (contains(ws[i + 1], '/') OR regexp_matches(ws[i + 1], '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$')) THEN ws[i] || ': ' || ws[i + 1] END
  FROM (SELECT *, ws[i] IN {_IN(lex.MEDICATION_WORDS)} AND i < len(ws) AS m FROM walk WHERE i <= len(ws)))
SELECT note_id, coalesce(string_agg(med, '|' ORDER BY i), '') AS medications, coalesce(string_agg(sym, '|' ORDER BY i), '') AS symptoms, coalesce(string_agg(vit, '|' ORDER BY i), '') AS vital_signs FROM walk GROUP BY 1"""


ORACLE = {
    "txt_clean": f"SELECT doc_id, md5({_clean()}) AS clean_md5, length({_clean()}) AS n_chars FROM documents",
    "txt_clean_profiles": "SELECT doc_id, " + ", ".join(f"{_prof(p)} AS {name}" for name, p in tx.PROFILES.items()) + " FROM documents",
    "txt_expand_abbrev": f"SELECT doc_id, md5({_expand('lower(text)')}) AS text_md5 FROM documents",
    "txt_notes_clean": f"{_N} SELECT note_id, {_clean()} AS clean, regexp_replace(text, '[0-9]', '', 'g') AS no_numbers FROM n",
    "txt_tokenize": f"{_D} SELECT doc_id, len(ws) AS n_tokens, md5(array_to_string(ws, ' ')) AS tokens_md5 FROM d",
    "txt_model_tokenize": f"{_M} SELECT doc_id, len(ws) AS n_tokens, md5(array_to_string(ws, ' ')) AS tokens_md5 FROM d",
    "txt_stopword_anti": f"SELECT term, count(*) AS n FROM (SELECT unnest({_btoks()}) AS term FROM documents) WHERE term NOT IN {_IN(lex.STOP_WORDS)} GROUP BY 1",
    "txt_vocab": f"{_D}, {_VOC.format(take=998)} SELECT term, n, id FROM voc",
    "txt_sequences": f"""{_D}, {_VOC.format(take=998)}, p AS (SELECT r, doc_id, i, coalesce(id, 1) AS id FROM (SELECT r, doc_id, unnest(ws[1:64]) AS term, unnest(range(len(ws[1:64]))) AS i FROM (SELECT row_number() OVER () AS r, * FROM d)) LEFT JOIN voc USING (term)),
q AS (SELECT r, list(id ORDER BY i) AS ids FROM p GROUP BY 1)
SELECT doc_id, array_to_string(list_concat(coalesce(ids, []), list_transform(range(64 - coalesce(len(ids), 0)), lambda x: 0)), ' ') AS ids FROM (SELECT row_number() OVER () AS r, doc_id FROM d) LEFT JOIN q USING (r)""",
    "txt_ngrams": f"{_D} SELECT gram, count(*) AS n FROM (SELECT ws[i] || ' ' || ws[i + 1] AS gram FROM (SELECT ws, unnest(range(1, len(ws))) AS i FROM d)) GROUP BY 1",
    "txt_stats": f"""{_D}, e AS (SELECT *, {_space('text')} AS t FROM d), f AS (SELECT *, list_filter(string_split(t, ' '), lambda w: w <> '') AS raw FROM e)
SELECT doc_id, len(ws) AS token_count, len(string_split(text, '.')) AS sentence_count, len(raw) AS word_count,
  round(list_sum(list_transform(raw, lambda w: strlen(w))) * 1e0 / nullif(len(raw), 0), 6) AS avg_word_length, round(len(raw) * 1e0 / len(string_split(text, '.')), 6) AS avg_sentence_length,
  round(len(list_filter(ws, lambda w: w IN {_IN(lex.CLINICAL_KEYWORDS)})) * 1e0 / nullif(len(ws), 0), 6) AS clinical_keyword_density FROM f""",
    "txt_tfidf_batch": f"{_D}, {_VOC.format(take=198)}, {_TC} SELECT doc_id, id, round(tc.n * 1e0 / total * ln((SELECT count(*) FROM d) * 1e0 / count(*) OVER (PARTITION BY id)), 6) AS v FROM tc JOIN voc USING (term)",
    "txt_tfidf_fitted": f"{_M}, {_MVOC.format(take=200)}, {_TC} SELECT doc_id, id, round(tc.n * 1e0 / total * idf, 6) AS v FROM tc JOIN voc USING (term)",
    "txt_bow": f"WITH d AS (SELECT doc_id, {_btoks()} AS ws FROM documents), voc AS (SELECT term, (row_number() OVER (ORDER BY n DESC, term) - 1)::INT AS id FROM (SELECT term, count(*) AS n FROM (SELECT unnest(ws) AS term FROM d) GROUP BY 1) QUALIFY id < 200), {_TC} SELECT doc_id, id, n::DOUBLE AS v FROM tc JOIN voc USING (term)",
    "txt_model_vocab": f"{_M}, {_MVOC.format(take=1000)} SELECT term, id, df, round(idf, 6) AS idf FROM voc",
    "txt_keywords": f"{_N}, d AS (SELECT note_id, unnest({_toks()}) AS term FROM n) SELECT note_id, term, count(*) AS n FROM d WHERE term IN {_IN(lex.CLINICAL_KEYWORDS)} GROUP BY 1, 2",
    "txt_model_keywords": f"{_N}, d AS (SELECT note_id, unnest({_mtoks()}) AS term FROM n) SELECT note_id, term, count(*) AS n FROM d WHERE term IN {_IN(lex.MODEL_KEYWORDS)} GROUP BY 1, 2",
    "txt_keywords_semi": f"{_D} SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS term FROM d) WHERE term IN {_IN(sorted({*lex.CLINICAL_KEYWORDS, *lex.MODEL_KEYWORDS, *lex.SYMPTOM_WORDS}))} GROUP BY 1, 2",
    "txt_entities_expanded": _ents(True),
    "txt_entities_raw": _ents(False),
    "txt_docs_keywords": f"{_D} SELECT doc_id, term, count(*) AS n FROM (SELECT r, doc_id, unnest(ws) AS term FROM (SELECT row_number() OVER () AS r, * FROM d)) WHERE term IN {_IN(_COMMON)} GROUP BY r, 1, 2",
    "txt_docs_entities": _ents(True, "SELECT doc_id AS note_id, text FROM documents").replace("SELECT note_id, coalesce(string_agg(med", "SELECT note_id AS doc_id, coalesce(string_agg(med"),
}
ORACLE["txt_fit_transform"] = ORACLE["txt_tfidf_batch"]
ORACLE["txt_fit_sequences"] = ORACLE["txt_sequences"].replace(_VOC.format(take=998), _VOC.format(take=198))
