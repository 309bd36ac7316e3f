"""Text operators: cleaning, tokens, vocabularies, sequences, TF-IDF, entities and statistics.

Everything is a column expression or an aggregation over (document, term) rows; matrices stay sparse. Term
weights are long tables (key, id, v), and vocabularies are tables (term, id) of at most their configured size.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lex
from ..functions.words import char_class, odd_spaces, run_counts, text_sizes, word_lists
from ..session import stored
from .base import Guarded

_RUNS = r"([\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_]+)"
_DROP_SPECIAL = r"[^\p{IsAlphabetic}\p{N}\p{IsWhite_Space}.,;:/\-+%><=]"
_PUNCTUATION = "!\"#$&'()*,.:;?@[\\]^_`{|}~"
_DROP_PUNCTUATION = r"[!\"#$&'()*,.:;?@\[\\\]^_`{|}~]"
_FLOAT = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|inf|infinity|nan)$"
PAD, UNK = 0, 1
#: Partitions of counted runs for each split of the texts.
RUN_PARTS = 8


@dataclass(frozen=True)
class CleaningConfig:
    lowercase: bool = True
    expand_abbreviations: bool = True
    remove_special_chars: bool = True
    remove_punctuation: bool = True
    remove_numbers: bool = False
    normalize_whitespace: bool = True
    remove_stop_words: bool = True


def _let(value: Column, f) -> Column:
    """``f(value)`` with ``value`` computed once: inside inner functions it would be computed for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


# Cleaning ---------------------------------------------------------------------------------------------------


def expand_abbreviations(text: Column, table: dict[str, str] | None = None) -> Column:
    """Replace whole words by their expansion in one pass over the word and non-word runs.

    A key that spans punctuation is replaced first, where neither neighbour is a word character.
    """
    table = lex.ABBREVIATIONS if table is None else table
    plain = {k: v for k, v in table.items() if k.isalnum()}
    for k, v in table.items():
        if k not in plain:
            text = F.regexp_replace(text, rf"(?<![\p{{L}}\p{{M}}\p{{N}}_])\Q{k}\E(?![\p{{L}}\p{{M}}\p{{N}}_])", v)
    words = F.create_map(*[F.lit(x) for kv in plain.items() for x in kv])
    # Membership is a hash set; a map is searched from its first key, which only the few hits pay for.
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_RUNS)), lambda r: F.when(r.isin(*plain), words[r]).otherwise(r)), "")


def remove_special_chars(text: Column) -> Column:
    return F.regexp_replace(text, _DROP_SPECIAL, "")


def remove_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, _DROP_PUNCTUATION, "")


def remove_numbers(text: Column) -> Column:
    return F.regexp_replace(text, "[0-9]", "")


def normalize_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clean_text(text: Column, config: CleaningConfig = CleaningConfig()) -> Column:
    if config.lowercase:
        text = F.lower(text)
    if config.expand_abbreviations:
        text = expand_abbreviations(text)
    if config.remove_special_chars:
        text = remove_special_chars(text)
    if config.remove_punctuation:
        text = remove_punctuation(text)
    if config.remove_numbers:
        text = remove_numbers(text)
    return normalize_whitespace(text) if config.normalize_whitespace else text


def _split(text: Column) -> Column:
    return F.filter(F.split(normalize_whitespace(text), " "), lambda t: t != "")


def tokenize(text: Column, config: CleaningConfig = CleaningConfig()) -> Column:
    """Cleaned words without stop words; words of one byte are dropped, so a lone two-byte letter stays.

    Lower-cased texts are cut by an Arrow function, which cleans each different piece once instead of each occurrence.
    """
    if config.lowercase:
        return _piecewise(F.lower(text), config)
    words = _split(clean_text(text, config))
    words = F.filter(words, lambda t: F.octet_length(t) > 1)
    if config.remove_stop_words:
        words = F.filter(words, lambda t: ~t.isin(*lex.STOP_WORDS))
    return words


def _rules(config: CleaningConfig) -> tuple:
    return (
        tuple(lex.ABBREVIATIONS.items()) if config.expand_abbreviations else None,
        char_class(r"[^\p{L}\p{M}\p{N}_]"),
        char_class(_DROP_SPECIAL) if config.remove_special_chars else None,
        (_PUNCTUATION if config.remove_punctuation else "") + ("0123456789" if config.remove_numbers else ""),
        lex.STOP_WORDS if config.remove_stop_words else (),
        spaces := char_class(r"(?U)\S"),
        odd_spaces(spaces),
    )


def _piecewise(text: Column, config: CleaningConfig) -> Column:
    rules = _rules(config)

    def run(texts: pa.Array) -> pa.Array:
        return word_lists(texts, rules)

    return F.arrow_udf(run, "array<string>")(text)


def model_tokenize(text: Column) -> Column:
    """The classifier's own words: alphanumeric characters only, more than two bytes, its own stop words."""
    words = F.transform(_split(F.lower(text)), lambda t: F.regexp_replace(t, r"[^\p{IsAlphabetic}\p{N}]", ""))
    return F.filter(words, lambda t: (F.octet_length(t) > 2) & ~t.isin(*lex.MODEL_STOP_WORDS))


def bag_tokenize(text: Column) -> Column:
    return _split(F.lower(text))


# Vocabularies -----------------------------------------------------------------------------------------------


def counted(tokens: Column) -> Column:
    """Array of (term, n): each different token and how often it stands there, from one sort inside the row."""

    def runs(ts: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(ts) - 1), lambda i: (i == 0) | (F.get(ts, i) != F.get(ts, i - 1)))
        rows = _let(starts, lambda at: F.transform(at, lambda p, k: F.struct(F.get(ts, p).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(ts)) - p).cast("long").alias("n"))))
        return F.when(F.size(ts) > 0, rows)

    return _let(F.sort_array(tokens), runs)


def term_counts(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, term, n, total): the number of each term and of all terms of a row; nothing is shuffled.

    Rows are counted one by one, so rows that share a key, or have none, stay apart.
    """
    slim = docs.select(key, tokens.alias("__tokens"))
    return slim.select(key, F.size("__tokens").alias("total"), F.inline(counted(F.col("__tokens"))))


def _numbered(docs: DataFrame, keep: list[str], tokens: Column) -> DataFrame:
    """``keep`` and the tokens of each row as __tokens, with a number __row that is the row's own whatever its key is."""
    return docs.select(F.monotonically_increasing_id().alias("__row"), *keep, tokens.alias("__tokens"))


def _ranked(counted: DataFrame, order: list[Column], take: int, first_id: int) -> DataFrame:
    """The first ``take`` rows with ids; only they are numbered, not the whole table."""
    top = counted.orderBy(*order).limit(take)
    return top.withColumn("id", (F.row_number().over(Window.orderBy(*order)) - 1 + first_id).cast("int"))


def vocabulary(docs: DataFrame, tokens: Column, max_features: int, min_frequency: int = 2, merge_into: DataFrame | None = None) -> DataFrame:
    """(term, id, n): terms of at least ``min_frequency`` by falling count and then by term; ids from 2.

    0 pads and 1 stands for unknown terms. A refit with ``merge_into`` keeps old terms that the new
    corpus does not rank; terms of both take the new id.
    """
    return vocabulary_of(docs.select(F.explode(tokens).alias("term"), F.lit(1).alias("n")), max_features, min_frequency, merge_into)


def vocabulary_of(counts: DataFrame, max_features: int, min_frequency: int = 2, merge_into: DataFrame | None = None) -> DataFrame:
    """``vocabulary`` from rows (term, n), as ``term_counts`` gives them."""
    totals = counts.groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= min_frequency)
    new = _ranked(totals, [F.desc("n"), F.asc("term")], max(max_features - 2, 0), 2)
    if merge_into is None:
        return new
    return new.unionByName(merge_into.join(new, "term", "left_anti").select("term", "n", "id"))


def model_vocabulary(docs: DataFrame, key: str, tokens: Column, max_features: int) -> DataFrame:
    """(term, id, df, idf): clinical keywords first, then by falling document frequency; ids from 0, idf = ln(N / df)."""
    n = docs.count()
    counted = docs.select(F.explode(F.array_distinct(tokens)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    order = [F.col("term").isin(*lex.MODEL_KEYWORDS).cast("int").desc(), F.desc("df"), F.asc("term")]
    return _ranked(counted, order, max_features, 0).withColumn("idf", F.log(F.lit(float(n)) / F.col("df")))


def bag_vocabulary(docs: DataFrame, max_features: int, text: str = "text") -> DataFrame:
    counted = docs.select(F.explode(bag_tokenize(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return _ranked(counted, [F.desc("n"), F.asc("term")], max_features, 0)


# Sequences and n-grams --------------------------------------------------------------------------------------


def sequences(docs: DataFrame, key: str, tokens: Column, vocab: DataFrame, length: int) -> DataFrame:
    """(key, ids) for every row: the first ``length`` tokens as ids, unknown ones as 1, padded with 0 at the tail."""
    rows = _numbered(docs, [key], F.slice(tokens, 1, length))
    seen = rows.select("__row", key, F.posexplode_outer("__tokens").alias("pos", "term")).join(F.broadcast(vocab.select("term", "id")), "term", "left")  # at most max_features terms
    ids = F.transform(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("id", F.lit(UNK)).alias("id"))))), lambda x: x["id"])
    out = seen.groupBy("__row", key).agg(ids.alias("ids"))
    return out.select(key, F.concat("ids", F.array_repeat(F.lit(PAD), F.lit(length) - F.size("ids"))).alias("ids"))


def ngrams(tokens: Column, n: int = 2) -> Column:
    """Space-joined runs of ``n`` tokens; none if there are fewer."""
    grams = lambda ts: F.transform(F.sequence(F.lit(1), F.size(ts) - n + 1), lambda i: F.array_join(F.slice(ts, i, n), " "))
    return _let(tokens, lambda ts: F.when(F.size(ts) >= n, grams(ts)).otherwise(F.array().cast("array<string>")))


def ngram_counts(docs: DataFrame, text: str = "text", n: int = 2, config: CleaningConfig = CleaningConfig()) -> DataFrame:
    """(gram, n): how often each run of ``n`` tokens stands in all texts.

    Runs of lower-cased texts are counted by numbers of words, in chunks, before they become strings and are shuffled.
    """
    if config.lowercase:
        rules = _rules(config)

        def run(batches):
            return run_counts(batches, rules, n)

        # Most runs are rare, so another partial sum before the shuffle would cost more than it saves, and the different ones grow with the input.
        parts = max(docs.rdd.getNumPartitions() * RUN_PARTS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        counts = docs.select(F.lower(text)).mapInArrow(run, "gram string, n long").repartition(parts, "gram")
    else:
        counts = docs.select(F.explode(ngrams(tokenize(F.col(text), config), n)).alias("gram"), F.lit(1).alias("n"))
    return counts.groupBy("gram").agg(F.sum("n").alias("n"))


# Weights ----------------------------------------------------------------------------------------------------


def tfidf(docs: DataFrame, key: str, tokens: Column, vocab: DataFrame) -> DataFrame:
    """(key, id, v) over the batch: tf counts unknown and repeated terms in its total, idf = ln(N / df) of this batch."""
    # What is left of the counts is written, or texts would be cut again for each use of it.
    known = stored(term_counts(docs, key, tokens).join(F.broadcast(vocab.select("term")), "term"))  # at most max_features terms
    return tfidf_of(known, docs.select(key).count(), key, vocab)


def tfidf_of(counts: DataFrame, n: int, key: str, vocab: DataFrame) -> DataFrame:
    """``tfidf`` from the ``term_counts`` of ``n`` documents; where these are stored, texts are cut into tokens once."""
    counts = counts.join(F.broadcast(vocab.select("term", "id")), "term")  # at most max_features terms
    df = counts.groupBy("id").agg(F.count("*").alias("df"))
    out = counts.join(F.broadcast(df), "id")  # one row a vocabulary term
    return out.select(key, "id", (F.col("n") / F.col("total") * F.log(F.lit(float(n)) / F.col("df"))).alias("v"))


def vectorize(docs: DataFrame, key: str, tokens: Column, vocab: DataFrame) -> DataFrame:
    """(key, id, v) with the idf that ``vocab`` froze at its fit."""
    counts = term_counts(docs, key, tokens).join(F.broadcast(vocab.select("term", "id", "idf")), "term")  # at most max_features terms
    return counts.select(key, "id", (F.col("n") / F.col("total") * F.col("idf")).alias("v"))


def vector_rows(docs: DataFrame, keep: list[str], tokens: Column, vocab: DataFrame, *aggs: Column) -> DataFrame:
    """``keep`` and ``aggs`` over the columns of ``vocab`` and the weight v, one row for each row of ``docs``, from one pass.

    Rows without a term of the vocabulary aggregate nulls. All terms of a row leave one task, so what is shuffled
    is a row's aggregates.
    """
    rows = _numbered(docs, keep, tokens)
    rows = rows.select("__row", *keep, F.size("__tokens").alias("total"), F.inline_outer(counted(F.col("__tokens"))))
    rows = rows.join(F.broadcast(vocab), "term", "left")  # at most max_features terms
    return rows.withColumn("v", F.col("n") / F.col("total") * F.col("idf")).groupBy("__row", *keep).agg(*aggs).drop("__row")


def bag_of_words(docs: DataFrame, key: str, vocab: DataFrame, text: str = "text") -> DataFrame:
    """(key, id, v): raw counts."""
    counts = term_counts(docs, key, bag_tokenize(F.col(text))).join(F.broadcast(vocab.select("term", "id")), "term")  # at most max_features terms
    return counts.select(key, "id", F.col("n").cast("double").alias("v"))


# Keywords, entities, statistics -----------------------------------------------------------------------------


def keyword_counts(docs: DataFrame, key: str, tokens: Column, keywords: tuple[str, ...] = lex.CLINICAL_KEYWORDS) -> DataFrame:
    """(key, term, n) for the keywords of each row."""
    return docs.select(key, F.inline(counted(F.filter(tokens, lambda t: t.isin(*keywords)))))


def _consumed(tokens: Column) -> Column:
    """For each token 0 (free), 1 (names a medication next) or 2 (is that medication).

    What was taken is not looked at again: on one letter a token, that is the leftmost non-overlapping match.
    """
    letters = F.array_join(F.transform(tokens, lambda t: F.when(t.isin(*lex.MEDICATION_WORDS), "m").otherwise("o")), "")
    states = F.split(F.regexp_replace(letters, "m.", "12"), "")
    return F.transform(states, lambda c: F.when(c == "1", 1).when(c == "2", 2).otherwise(0))


def entities(tokens: Column) -> Column:
    """Struct of arrays: medications, symptoms and vital_signs, in the order of the tokens."""
    pairs = _let(tokens, lambda ts: F.arrays_zip(ts.alias("t"), _consumed(ts).alias("s"), F.slice(ts, F.lit(2), F.greatest(F.size(ts) - 1, F.lit(0))).alias("n")))

    def found(ps: Column) -> Column:
        value = lambda p: F.contains(p["n"], F.lit("/")) | p["n"].rlike(_FLOAT)
        vital = F.filter(ps, lambda p: (p["s"] == 0) & p["t"].isin(*lex.VITAL_WORDS) & value(p))
        return F.struct(
            F.transform(F.filter(ps, lambda p: p["s"] == 2), lambda p: p["t"]).alias("medications"),
            F.transform(F.filter(ps, lambda p: (p["s"] == 0) & p["t"].isin(*lex.SYMPTOM_WORDS)), lambda p: p["t"]).alias("symptoms"),
            F.transform(vital, lambda p: F.concat(p["t"], F.lit(": "), p["n"])).alias("vital_signs"),
        )

    return _let(pairs, found)


def statistics(text: Column, tokens: Column) -> Column:
    """Struct of token, sentence and word counts, mean word bytes, words a sentence and keyword density (NULL where undefined)."""
    words = _split(text)
    sentences = F.size(F.split(text, r"\."))
    n_bytes = F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.octet_length(w))
    keywords = F.size(F.filter(tokens, lambda t: t.isin(*lex.CLINICAL_KEYWORDS)))
    return _ratios(F.size(tokens), sentences, F.size(words), n_bytes, keywords)


def _ratios(tokens: Column, sentences: Column, words: Column, n_bytes: Column, keywords: Column) -> Column:
    return F.struct(
        tokens.alias("token_count"),
        sentences.alias("sentence_count"),
        words.alias("word_count"),
        F.try_divide(n_bytes.cast("double"), words).alias("avg_word_length"),
        F.try_divide(words.cast("double"), sentences).alias("avg_sentence_length"),
        F.try_divide(keywords.cast("double"), tokens).alias("clinical_keyword_density"),
    )


def text_statistics(text: Column, config: CleaningConfig = CleaningConfig()) -> Column:
    """``statistics`` of a text and its tokens; of lower-cased texts an Arrow function returns the counts alone, from one cut.

    Lower case leaves white space and full stops as they are, so what is not white space has the bytes of the text itself.
    """
    if not config.lowercase:
        return statistics(text, tokenize(text, config))
    rules = _rules(config)

    def run(texts: pa.Array) -> pa.Array:
        return text_sizes(texts, rules, lex.CLINICAL_KEYWORDS)

    sizes = F.arrow_udf(run, "tokens long, keywords long, words long, sentences long, space long")(F.lower(text))
    ratios = lambda s: _ratios(s["tokens"].cast("int"), s["sentences"].cast("int"), s["words"].cast("int"), F.octet_length(text) - s["space"], s["keywords"])
    return _let(sizes, ratios)


# Chain ------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class TextConfig:
    key: str = "doc_id"
    text: str = "text"
    max_features: int = 5000
    max_length: int = 256
    min_frequency: int = 2
    cleaning: CleaningConfig = CleaningConfig()


class TextPreprocessor(Estimator):
    """Fit a vocabulary; the model gives batch TF-IDF rows and, by ``sequences``, padded ids."""

    def __init__(self, config: TextConfig | None = None):
        super().__init__()
        self.config = config or TextConfig()

    def with_min_frequency(self, n: int) -> "TextPreprocessor":
        return TextPreprocessor(replace(self.config, min_frequency=n))

    def with_cleaning(self, cleaning: CleaningConfig) -> "TextPreprocessor":
        return TextPreprocessor(replace(self.config, cleaning=cleaning))

    def _fit(self, df: DataFrame) -> "TextModel":
        c = self.config
        return TextModel(c, vocabulary(df, tokenize(F.col(c.text), c.cleaning), c.max_features, c.min_frequency).cache())


class TextModel(Model, Guarded):
    def __init__(self, config: TextConfig, vocab: DataFrame | None = None):
        super().__init__()
        self.config, self.vocab = config, vocab

    def _tokens(self) -> Column:
        self.check_fitted(self.vocab)
        return tokenize(F.col(self.config.text), self.config.cleaning)

    def _transform(self, df: DataFrame) -> DataFrame:
        return tfidf(df, self.config.key, self._tokens(), self.vocab)

    def sequences(self, df: DataFrame) -> DataFrame:
        return sequences(df, self.config.key, self._tokens(), self.vocab, self.config.max_length)


PROFILES = {
    "clinical_notes": TextConfig(max_features=5000, max_length=256, min_frequency=2, cleaning=CleaningConfig(remove_special_chars=False)),
    "discharge_summaries": TextConfig(max_features=10000, max_length=512, min_frequency=3, cleaning=CleaningConfig(remove_special_chars=False, remove_punctuation=False, remove_stop_words=False)),
    "lab_reports": TextConfig(max_features=3000, max_length=128, min_frequency=1, cleaning=CleaningConfig(remove_special_chars=False, remove_punctuation=False)),
}
