"""Language identification by cross-parsing entropy.

A bounded sample of labelled text per language becomes a suffix automaton. A text
is parsed against each: it is cut, from left to right, into the longest phrases
that occur in the sample. A language's entropy is its phrases times the bits of a
position in its sample, for each letter; the language of least entropy wins.

For speed each automaton is completed to a table in which a letter that does not
continue the phrase leads to where that letter leads from the root, with a mark
that a phrase ended. Texts are cut into segments of equal length, and all segments
of a batch walk the table side by side. A segment first starts with no phrase open;
where the one before it left a phrase open, it walks again from there, until the
two walks meet, which they do after a few letters. So the phrases are those of the
whole text, wherever its segments end.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.llm.bpe import LETTER, _class_table, chunks_of
from peakloom.llm.shared import text_of, text_rows

UNDETERMINED = "und"
#: Letters of a segment.
SEGMENT = 256
#: Bytes of text whose segments walk side by side.
CHUNK = 1 << 19
#: Classes of ids that each offer one document to a language's sample.
OFFERS = 4096


@dataclass(frozen=True)
class LanguageModel:
    """The sample of each language, lower-cased, in the order of the languages' names."""

    languages: tuple[str, ...]
    samples: tuple[str, ...]


def fit(
    docs: DataFrame, where: Column, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
    sample_docs: int = 96, sample_chars: int = 30_000,
) -> LanguageModel:
    """Learn from the rows of docs that fulfil `where` and have a language.

    Of each language, sample_docs documents whose ids hash low give a passage each, sample_chars code points in all;
    that is the bound of the sample, which does not grow with the corpus. A passage starts at a place drawn from the
    id, so that texts are not sampled by their beginnings alone.
    """
    rows = docs.where(where & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("h"), text_of(F.col(text_col)).alias("text")
    )
    offers = rows.groupBy("lang", F.pmod("h", F.lit(OFFERS)).alias("class")).agg(F.min("h").alias("h"))
    lowest = Window.partitionBy("lang").orderBy("h")  # OFFERS rows of a language at most
    chosen = offers.withColumn("k", F.row_number().over(lowest)).where(F.col("k") <= sample_docs)
    keys = {(r["lang"], r["h"]) for r in chosen.collect()}
    size = max(1, sample_chars // sample_docs)
    spare = F.greatest(F.lit(1), F.char_length("text") - size + 1)
    passage = F.substring(F.col("text"), F.pmod(F.xxhash64("h"), spare).cast("int") + 1, F.lit(8 * size))
    hit = rows.where(F.col("h").isin([h for _, h in keys])) if keys else rows.limit(0)
    texts = hit.groupBy("lang", "h").agg(F.max(passage).alias("text")).collect()
    samples: dict[str, str] = {}
    found = sorted((r for r in texts if (r["lang"], r["h"]) in keys and any(c.isalpha() for c in r["text"])), key=lambda r: (r["lang"], r["h"]))
    for most in (size, 8 * size):  # where documents are short or few, others give more
        for r in found:
            have, more = samples.get(r["lang"], ""), r["text"][:size] if most == size else r["text"][size:most]
            if more and len(have) < sample_chars:
                samples[r["lang"]] = (have + " " + more.lower())[:sample_chars]
    return LanguageModel(tuple(sorted(samples)), tuple(samples[k] for k in sorted(samples)))


def _automaton(symbols: list[int], alphabet: int) -> np.ndarray:
    """Transitions of the suffix automaton of a sample, -1 where there is none; state 0 is the root."""
    to = array("i", [-1]) * (alphabet * max(2, 2 * len(symbols)))  # a state's row lies at its number times alphabet
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(link)
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and to[p * alphabet + c] < 0:
            to[p * alphabet + c] = cur
            p = link[p]
        if p >= 0:
            q = to[p * alphabet + c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(link)
                to[clone * alphabet : (clone + 1) * alphabet] = to[q * alphabet : (q + 1) * alphabet]
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and to[p * alphabet + c] == q:
                    to[p * alphabet + c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return np.frombuffer(to, np.int32).reshape(-1, alphabet)[: len(link)]


class _Parser:
    """The completed tables of a model; built once in a worker process."""

    def __init__(self, model: LanguageModel):
        letters = sorted({c for s in model.samples for c in s if c.isalpha()})
        # Symbol 0: what is no letter; 1: a letter that no sample has; last: padding, which changes nothing.
        self.symbol = np.where(_class_table() == LETTER, 1, 0).astype(np.uint8 if len(letters) < 250 else np.int32)
        for k, c in enumerate(letters):
            for form in {c, c.upper(), c.title()}:
                if len(form) == 1:
                    self.symbol[ord(form)] = k + 2
        self.pad = len(letters) + 2
        width = self.pad + 1
        self.tables, self.bits = [], []
        for sample in model.samples:
            symbols = self.squeezed(np.frombuffer(sample.encode("utf-32-le"), np.uint32), np.array([0, len(sample)]))[0]
            to = _automaton(symbols.tolist(), width)
            # One more state: after a letter that the sample lacks, which is a phrase by itself.
            lone = len(to)
            to = np.vstack((to, np.full(width, -1, np.int32)))
            gone = to < 0
            gone[0] = False  # no phrase is open yet
            root = np.where(to[0] < 0, np.int32(lone), to[0])
            to = np.where(to < 0, root[None, :], to)
            to[:, self.pad], gone[:, self.pad] = np.arange(len(to)), False
            self.tables.append((to * np.int32(2 * width) + gone).ravel())
            self.bits.append(np.log2(max(2, len(symbols))))
        self.width = width

    def squeezed(self, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols with runs of non-letters made one, and the texts' offsets among them."""
        symbols = self.symbol[points]
        keep = symbols != 0
        keep[1:] |= symbols[:-1] != 0
        keep[offsets[:-1][offsets[:-1] < len(points)]] = True
        return symbols[keep], np.concatenate(([0], np.cumsum(keep)))[offsets]

    def phrases(self, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases of each text by language, its symbols, and whether it has a letter."""
        symbols, upto = self.squeezed(points, offsets)
        sizes = np.diff(upto)
        letters = np.concatenate(([0], np.cumsum(symbols != 0)))[upto]
        count = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(sizes)), count)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        start = upto[:-1][owner] + SEGMENT * place
        room = np.minimum(SEGMENT, upto[1:][owner] - start)
        padded = np.concatenate((symbols, np.full(SEGMENT, self.pad, symbols.dtype)))
        matrix = np.lib.stride_tricks.sliding_window_view(padded, SEGMENT)[start] if len(owner) else np.zeros((0, SEGMENT), symbols.dtype)
        columns = np.where(np.arange(SEGMENT)[:, None] < room[None, :], matrix.T, self.pad).astype(np.int32)
        found = np.zeros((len(self.tables), len(sizes)), np.int64)
        follows = np.flatnonzero(place > 0)
        for k, table in enumerate(self.tables):
            walk = np.zeros((SEGMENT + 1, len(owner)), np.int32)  # twice the state's row, and whether a phrase ended there
            for c, column in enumerate(columns):
                walk[c + 1] = table[(walk[c] >> 1) + column]
            self._joined(table, columns, walk, follows)
            ended = (walk[1:] & 1).sum(axis=0)
            found[k] = np.bincount(owner, ended, len(sizes)) + (sizes > 0)  # the phrase that is open at a text's end
        return found, sizes, np.diff(letters) > 0

    @staticmethod
    def _joined(table: np.ndarray, columns: np.ndarray, walk: np.ndarray, follows: np.ndarray) -> None:
        """Walk each segment of follows again from where the one before it ends, up to where the old walk is met; until none changes."""
        again = follows
        while len(again):
            at = walk[-1, again - 1] & ~np.int32(1)
            changed = at != walk[0, again]
            again, at = again[changed], at[changed]
            walk[0, again] = at
            live = np.arange(len(again))
            for c, column in enumerate(columns):
                at = table[(at >> 1) + column[again[live]]]
                apart = (at >> 1) != (walk[c + 1, again[live]] >> 1)
                walk[c + 1, again[live]] = at
                live, at = live[apart], at[apart]
                if not len(live):
                    break
            # Those whose end has changed send the next segments of their texts on another walk.
            again = np.intersect1d(again[live] + 1, follows)


@lru_cache(maxsize=1)
def _parser(model: LanguageModel) -> _Parser:
    return _Parser(model)


def _predicted(model: LanguageModel, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    leads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    parser = _parser(model)
    found, sizes, lettered = parser.phrases(points, leads[offsets])
    entropy = found * np.array(parser.bits)[:, None] / np.maximum(1, sizes)
    best = np.argmin(entropy, axis=0)
    weight = np.maximum(entropy, 1e-9) ** -4.0
    score = np.where(lettered, weight.max(axis=0) / weight.sum(axis=0), 0.0)
    return [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)], score


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score.

    score is the winner's share of the inverse entropies (to the power 4), 0 to 1. A text that is null or has no
    letter is "und" with score 0, and so is every text if no language was learned. Equal entropies go to the
    language that sorts first. Texts of any length are parsed whole.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in chunks_of(batch.column(1), CHUNK):
                if model.languages:
                    lang, score = _predicted(model, data, offsets)
                else:
                    lang, score = [UNDETERMINED] * (j - i), np.zeros(j - i)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(lang, pa.string()), pa.array(score)], [id_col, "lang_pred", "score"])

    return text_rows(docs).select(id_col, docs[text_col].cast("string").alias("__text")).mapInArrow(rows, f"`{id_col}` {id_type}, lang_pred string, score double")
