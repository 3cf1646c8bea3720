"""Language identification by compression.

A language is a zstandard dictionary of raw content: texts of a bounded sample of labelled rows. A text, in lower
case, is compressed once with every dictionary, in blocks so that a long text stays a matter of the dictionary and not
of its own start, and the language with the fewest bytes wins. The score is the margin to the next one; a narrow margin
is a rejection. A few words often come to the same number of whole bytes, so a short text with a narrow margin is
measured again with its words in other orders, and the sums of these sizes decide.

Learning takes at most SAMPLE_TEXTS distinct texts of each language (a bound, not a share of the corpus), those with
the smallest hashes, and fills the dictionary with them, whole and in that order, as far as DICTIONARY_BYTES go. A
language with fewer texts gives all; one whose texts are all too long for that gives its shortest.

Nulls: a null text, and a text without a letter, is ``und`` with score 0, and nothing is learned from it. Rows with a
null lang are predicted but not learned from. Ties go to the language first in order. With nothing to learn from, all
are ``und``; with one language, every text is that language with score 1. Empty tables give empty results. What is
learned depends on the set of (lang, text) alone, so repeated rows, partitions and extra columns change nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import need, slices, small_batches

SAMPLE_TEXTS, DICTIONARY_BYTES = 160, 96 << 10
#: Bytes of a block, and of a text that is measured again where its margin is narrow.
BLOCK_BYTES, SHORT_BYTES, LEVEL = 4096, 200, 7
UNKNOWN = "und"
#: Share of the second-best size by which the best has to be smaller.
NARROW = 0.003
_letter = regex.compile(r"\p{L}").search


def learn(docs: DataFrame, usable: Column | None = None) -> dict[str, bytes]:
    """Dictionaries by language from the rows of docs (doc_id, text, lang) that usable selects."""
    need(docs, "doc_id", "text", "lang")
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows if usable is None else rows.filter(usable)
    place = F.xxhash64(F.lit(11), "text")
    marked = rows.select("lang", "text", place.alias("place"), F.octet_length(F.lower("text")).alias("size"))
    # a text is one however often it occurs, and texts that no dictionary can hold are left for languages with no others
    fits = F.col("size") <= DICTIONARY_BYTES
    found = marked.select("lang", "place", fits.alias("fits")).distinct().groupBy("lang").agg(F.count_if("fits").alias("n")).collect()  # a row for each language
    if not found:
        return {}
    # twice as many as wanted by a threshold on the hash; of these the wanted ones with the smallest hashes, as they fit
    share = {r.lang: int(min(1.0, 2 * SAMPLE_TEXTS / r.n) * ((1 << 30) - 1)) if r.n else -1 for r in found}
    limit = F.create_map(*(F.lit(x) for item in share.items() for x in item))
    some = marked.filter(fits & (F.pmod("place", F.lit(1 << 30)) <= limit[F.col("lang")])).select("lang", "place", "size").distinct()
    chosen: dict[str, list[int]] = {r.lang: [] for r in found}
    room, seen = dict.fromkeys(chosen, DICTIONARY_BYTES), dict.fromkeys(chosen, 0)
    for lang, at, size in sorted(map(tuple, some.collect()), key=lambda r: (r[0], r[1] % (1 << 30), r[1])):
        if seen[lang] < SAMPLE_TEXTS and size <= room[lang]:
            chosen[lang].append(at)
            room[lang] -= size + 1  # and a line feed
        seen[lang] += 1
    wanted = F.lit(False)
    for lang, places in chosen.items():
        if places:
            wanted |= (F.col("lang") == lang) & F.col("place").isin(places)
    texts = {(r.lang, r.place): r.text for r in marked.filter(wanted).groupBy("lang", "place").agg(F.first("text").alias("text")).collect()}  # a dictionary each
    out = {lang: [texts[lang, at].lower().encode() for at in places] for lang, places in chosen.items()}
    if long := [lang for lang, places in chosen.items() if not places]:
        for r in marked.filter(F.col("lang").isin(long)).groupBy("lang").agg(F.min(F.struct("size", "place", "text")).alias("x")).collect():
            out[r.lang].append(r.x.text.lower().encode())
    return {lang: b"\n".join(reversed(parts)) for lang, parts in sorted(out.items())}


class Identifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = sorted(dictionaries)
        self.coders = []
        for lang in self.langs:
            data = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False).compress)

    def sizes(self, text: bytes) -> np.ndarray:
        """Compressed bytes by language."""
        blocks = [text[k : k + BLOCK_BYTES] for k in range(0, len(text), BLOCK_BYTES)]
        return np.array([sum(len(c(b)) for b in blocks) for c in self.coders])

    def predict(self, text: bytes) -> tuple[str, float]:
        letters = text.decode()
        if not self.langs or not _letter(letters):
            return UNKNOWN, 0.0
        if len(self.langs) == 1:
            return self.langs[0], 1.0
        text = letters.lower().encode()
        lang, margin = self.narrowest(self.sizes(text))
        if margin < NARROW and len(text) <= SHORT_BYTES:
            words = text.split()
            lang, margin = self.narrowest(sum(self.sizes(b" ".join([text, *words[i:], *words[:i]])) for i in range(len(words))))
        return lang, margin

    def narrowest(self, sizes: np.ndarray) -> tuple[str, float]:
        """The language with the smallest size, and by what share of it the next one is larger."""
        best = int(sizes.argmin())
        second = int(np.delete(sizes, best).min())
        return self.langs[best], float((second - sizes[best]) / second)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], narrow: float = NARROW) -> DataFrame:
    """docs with lang_pred, lang_score (0 to 1) and lang_rejected, under these names or longer ones if docs has them."""
    need(docs, "text")
    small_batches(docs.sparkSession)
    names = []
    for name in ("lang_pred", "lang_score", "lang_rejected"):
        while name in docs.columns:
            name += "_"
        names.append(name)
    fields = docs.schema
    for name, kind in zip(names, ("string", "double", "boolean"), strict=True):
        fields = type(fields)([*fields.fields]).add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict: Callable[[bytes], tuple[str, float]] = Identifier(dictionaries).predict
        for batch, texts in slices(batches):
            langs, scores = zip(*map(predict, texts), strict=True)
            rejected = [x == UNKNOWN or s < narrow for x, s in zip(langs, scores, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs), pa.array(scores, pa.float64()), pa.array(rejected)], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, fields)
