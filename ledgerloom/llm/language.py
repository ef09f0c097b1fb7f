"""Language identification by cross-parsing.

For each labelled language a suffix automaton holds a bounded sample of its text. A document is parsed against each
automaton into longest matches: a phrase goes on while the automaton has a transition and the next one starts at the
first character that has none. The language that needs the fewest phrases wins; a phrase of a language with ``n``
sampled characters costs ``log2(n)`` bits, so samples of unequal size compare, but never less than one symbol of the
alphabet of all samples would. So a label with hardly any text can't be cheap, and a symbol it lacks costs the alphabet.

Texts are lower-cased; letters of the samples are symbols, runs of anything that is no letter are one blank, other
letters match nothing. Texts are parsed in windows of ``WINDOW`` symbols, each starting a new phrase, so that
documents of any length share the lanes of one vectorised walk through the automata.

The samples are the only thing fitted: per language the ``SAMPLE_TEXTS`` distinct texts of the smallest hashes among
those with a letter in their sampled part (a label without such texts is no language), the
first ``TEXT_CHARS`` characters of each and ``SAMPLE_CHARS`` together. The label column is read for nothing else.

Defined cases: a null text or one without a letter is ``und`` with score 0; ties go to the language first in code
point order, with score 0; without any labelled row every document is ``und``; null ids and repeated rows stay rows.
Extra columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import let_go, once_per_worker, ship_package, texts_of
from ledgerloom.operators.scale import take_per_key

SAMPLE_TEXTS, TEXT_CHARS, SAMPLE_CHARS = 96, 1000, 24_000
WINDOW = 1024
SALTS = 64
BLANK = " "
UNKNOWN = "und"
#: Symbols a phrase needs on average for a text to count as written in a language.
MIN_PHRASE = 1.5


def symbols(text: str) -> str:
    """Lower-cased text with a blank for every character that is no letter."""
    low = text.lower()
    return low if low.isalpha() else "".join([c if c.isalpha() else BLANK for c in low])


def suffix_automaton(text: str) -> tuple[list[dict[str, int]], list[int]]:
    """Transitions and longest lengths of the states that accept exactly the substrings of ``text``."""
    edges, link, length = [{}], [-1], [0]
    last = 0
    for symbol in text:
        new = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        state = last
        while state >= 0 and symbol not in edges[state]:
            edges[state][symbol] = new
            state = link[state]
        if state >= 0:
            target = edges[state][symbol]
            if length[target] == length[state] + 1:
                link[new] = target
            else:
                copy = len(edges)
                edges.append(dict(edges[target]))
                length.append(length[state] + 1)
                link.append(link[target])
                link[target] = link[new] = copy
                while state >= 0 and edges[state].get(symbol) == target:
                    edges[state][symbol] = copy
                    state = link[state]
        last = new
    return edges, length


class Parser:
    """Counts phrases of many texts against several languages at once.

    All automata lie in one table: the entry of a state and symbol is twice the next state's row start, plus one
    where the symbol starts a new phrase. Each automaton's last row is for the place before a text and behind a symbol
    that the language doesn't have, which is a phrase of its own: there every symbol starts a phrase.
    """

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.langs = [lang for lang, _ in samples]
        letters = sorted({c for _, text in samples for c in text} - {BLANK})
        self.width = len(letters) + 2  # blank, letters, and one symbol for letters no sample has
        code = {BLANK: 0, **{c: i + 1 for i, c in enumerate(letters)}}
        top = max(map(ord, code))
        self.codes = np.full(top + 2, self.width - 1, np.int32)
        for c, i in code.items():
            self.codes[ord(c)] = i
        tables, self.starts, base = [], [], 0
        for _, text in samples:
            edges, length = suffix_automaton(text)
            order = np.argsort(length, kind="stable")  # short contexts, the frequent ones, lie together
            row = np.empty(len(edges), np.int64)
            row[order] = (base + np.arange(len(edges))) * self.width
            start = (base + len(edges)) * self.width
            root = np.full(self.width, 2 * start + 1, np.int64)
            for c, target in edges[0].items():
                root[code[c]] = 2 * row[target] + 1
            table = np.tile(root, (len(edges) + 1, 1))
            for place, state in enumerate(order.tolist()):
                for c, target in edges[state].items():
                    table[place, code[c]] = 2 * row[target]
            tables.append(table)
            self.starts.append(start)
            base += len(edges) + 1
        self.table = np.concatenate(tables).ravel()
        self.table = self.table.astype(np.int32 if self.table.max() < 2**31 else np.int64)
        self.bits = np.log2([max(self.width, len(text)) for _, text in samples])

    def encode(self, text: str) -> np.ndarray:
        points = np.frombuffer(symbols(text).encode("utf-32-le", "surrogatepass"), "<u4")
        codes = self.codes[np.minimum(points, len(self.codes) - 1)]
        blank = codes == 0
        return codes[~(blank & np.concatenate(([True], blank[:-1])))]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases per text and language."""
        size = np.array([len(t) for t in texts], np.int64)
        per = -(-size // WINDOW)
        owner = np.repeat(np.arange(len(texts)), per)
        first = np.repeat(np.cumsum(size) - size, per)
        inner = (np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)) * WINDOW
        length = np.minimum(np.repeat(size, per) - inner, WINDOW)
        order = np.argsort(-length, kind="stable")
        start, length, owner = (first + inner)[order], length[order], owner[order]
        flat = np.concatenate(texts) if len(owner) else np.empty(0, np.int32)
        state = np.repeat(np.array(self.starts, self.table.dtype)[:, None], len(owner), axis=1)
        count = np.zeros(state.shape, np.int32)
        lanes = np.searchsorted(-length, -np.arange(WINDOW), "left")  # windows longer than each step
        for step in range(int(length[0]) if len(length) else 0):
            n = lanes[step]
            entry = self.table.take(state[:, :n] + flat[start[:n] + step])
            count[:, :n] += entry & 1
            state[:, :n] = entry >> 1
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        np.add.at(out, owner, count.T)
        return out

    def predict(self, texts: list[str | None], rows: int = 2_000_000) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and mean phrase length (0 where nothing was parsed) of each text."""
        langs, scores, spans = [], [], []
        held: list[np.ndarray] = []

        def flush() -> None:
            counts = self.phrases(held)
            for codes, row in zip(held, counts):
                if not (codes > 0).any() or not self.langs:
                    langs.append(UNKNOWN), scores.append(0.0), spans.append(0.0)
                    continue
                cost = row * self.bits
                best = int(np.argmin(cost))
                rest = np.delete(cost, best)
                langs.append(self.langs[best])
                scores.append(float(1 - cost[best] / rest.min()) if len(rest) else 1.0)
                spans.append(len(codes) / row[best])
            held.clear()

        waiting = 0
        for text in texts:
            held.append(self.encode(text or ""))
            waiting += len(held[-1])
            if waiting >= rows:
                flush()
                waiting = 0
        flush()
        return langs, np.array(scores, float), np.array(spans, float)


@once_per_worker
def parser_of(samples: tuple[tuple[str, str], ...]) -> Parser:
    """The automata of the samples, built once per worker process."""
    return Parser(samples)


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: those whose id's CRC-32, as text, leaves 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def samples(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
            texts: int = SAMPLE_TEXTS, text_chars: int = TEXT_CHARS, chars: int = SAMPLE_CHARS) -> tuple[tuple[str, str], ...]:
    """Bounded sample per language, in code point order of the languages.

    First the smallest distinct text hashes per language are found from hashes alone, then those texts are fetched,
    so copies fill no sample and no text is shuffled that isn't sampled.
    """
    labelled = docs.filter(~held_out(F.col(doc_id)) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.xxhash64(text).alias("hash"), F.substring(text, 1, text_chars).alias("head"))
    labelled = labelled.filter(F.col("head").rlike(r"\p{L}"))
    hashes = labelled.select("lang", "hash").distinct()
    salted = hashes.withColumn("salt", F.pmod("hash", F.lit(SALTS)))  # a language of most rows is spread
    few = take_per_key(salted, ["lang", "salt"], [F.col("hash")], texts, "place").drop("place", "salt")
    chosen = take_per_key(few, ["lang"], [F.col("hash")], texts, "place")
    rows = (labelled.join(chosen, ["lang", "hash"]).groupBy("lang", "place").agg(F.min("head").alias("head"))
            .collect())
    out: dict[str, str] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["place"])):
        clean = BLANK.join(symbols(row["head"]).split())
        if clean:
            out[row["lang"]] = (out.get(row["lang"], "") + BLANK + clean)[:chars]
    return tuple(out.items())


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, phrase_chars`` for every row; ``phrase_chars`` is the mean phrase length."""
    ship_package(docs.sparkSession)
    learned = samples(docs, doc_id, text, lang)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(parser_of)
        parser = parser_of(learned) if learned else None
        for batch in texts_of(batches, 1024):
            given = batch.column(1).to_pylist()
            names, scores, spans = parser.predict(given) if parser else ([UNKNOWN] * len(given), [0.0] * len(given),
                                                                        [0.0] * len(given))
            yield pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                                   pa.array(spans, pa.float64())], ["doc_id", "lang_pred", "score", "phrase_chars"])

    found = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        predicted, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, lang_pred string, score double, phrase_chars double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "phrase_chars")


def keep_known(docs: DataFrame, min_phrase: float = MIN_PHRASE, doc_id: str = "doc_id", text: str = "text",
               lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` in one of the learned languages.

    Rejected are ``und`` and texts whose mean phrase is shorter than ``min_phrase`` symbols: parsed in the best
    language, hardly any two of their symbols follow each other as they do there.
    """
    ship_package(docs.sparkSession)
    learned = samples(docs, doc_id, text, lang)

    @F.pandas_udf("double")
    def phrase_chars(given: pd.Series) -> pd.Series:
        if not learned:
            return pd.Series(np.zeros(len(given)))
        let_go(parser_of)
        names, _, spans = parser_of(learned).predict(given.where(given.notna(), None).tolist())
        return pd.Series(np.where(np.array(names, object) == UNKNOWN, 0.0, spans), dtype=float)

    packed = docs.select(F.struct("*").alias("row"), phrase_chars(F.col(text)).alias("span"))
    return packed.filter(F.col("span") >= min_phrase).select("row.*")
