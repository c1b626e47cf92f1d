"""Language identification by character language models, interpolated Kneser-Ney of order four.

Texts become streams of letters, in lower case, with one separator for whatever
lies between words.  Four-letter windows are counted for each language over all texts that
may teach, in Spark; each language's counts become sorted arrays of hashes with their
probabilities and back-off weights.  A text takes the language of the lowest cross-entropy
for each letter, and is rejected where that is higher than texts of the language have it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.llm.common import written

ORDER = 4
WIDE = 16
#: Letters that are looked at together in a task, and distinct windows that a task holds before it sends them.
CHUNK, HELD = 1 << 20, 1 << 20
#: Bins by which repeated windows of a chunk are found.
BINS = 18
#: Parts of the texts that may teach; texts of a part are calibrated on by models of all the others.
FOLDS = 4
#: The values of sharpness that calibration tries, what entropies are multiplied by to be whole numbers, and the bits that a pass of :func:`quantiles` settles.
GRID, SCALE, DIGITS = np.exp2(np.arange(-6, 7)), 10**9, 12
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """The lower-case letter of each 16-bit code point, 0 where it is no letter."""
    table = np.zeros(1 << WIDE, np.uint16)
    for code in range(1 << WIDE):
        if (char := chr(code)).isalpha():
            table[code] = ord(char.lower()[0]) & 0xFFFF
    return table


def _folded(codes: np.ndarray) -> np.ndarray:
    """Code points to letters; rarer letters beyond 16 bits share the codes of private use, which no letter has."""
    out = _letters()[np.minimum(codes, (1 << WIDE) - 1)]
    if len(far := np.flatnonzero(codes >> WIDE)):
        values, which = np.unique(codes[far], return_inverse=True)
        out[far] = np.array([0xE000 + v % 6400 if chr(v).isalpha() else 0 for v in values.tolist()], np.uint16)[which]
    return out


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(windows of four letters as unsigned 64-bit numbers, the text of each); a text starts behind separators and ends with one."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    letters = _folded(codes)
    keep = letters != 0
    keep[1:] |= (letters[:-1] != 0) & (owner[1:] == owner[:-1])  # the first separator behind a word
    letters, owner = letters[keep], owner[keep]
    stream = np.zeros(len(letters) + ORDER * len(texts), np.uint64)
    stream[np.arange(len(letters)) + ORDER * owner + ORDER - 1] = letters
    whose = np.repeat(np.arange(len(texts)), np.bincount(owner, minlength=len(texts)) + ORDER)
    said = stream != 0
    said[1:] |= stream[:-1] != 0
    said[: ORDER - 1] = False
    whole = stream.copy()
    for back in range(1, ORDER):
        whole[back:] |= stream[:-back] << np.uint64(WIDE * back)
    return whole[said], whose[said]


def mixed(keys: np.ndarray) -> np.ndarray:
    """A one-to-one hash of 64-bit numbers."""
    x = keys.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _counted(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their times."""
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(times, starts) if len(keys) else times


def _parts(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(first place, texts) of runs of about CHUNK letters; a longer text is a run of its own."""
    start = size = 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= CHUNK:
            yield start, [t or "" for t in texts[start : k + 1]]
            start, size = k + 1, 0
    if start < len(texts):
        yield start, [t or "" for t in texts[start:]]


def window_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n, n_0, ...): how often each window occurs in the texts of each language, and in those outside each fold; ``rows`` has lang, fold (int) and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def told() -> Iterator[pa.RecordBatch]:
            for (lang, fold), found in held.items():
                grams, times = _counted(*(np.concatenate([x[i] for x in found]) for i in (0, 1)))
                for k in range(0, len(grams), HELD):
                    part = grams[k : k + HELD].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([fold] * len(part), pa.int32()), pa.array(part), pa.array(times[k : k + HELD])], ["lang", "fold", "gram", "n"])
            held.clear()

        for batch in batches:
            kinds = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for start, part in _parts(batch.column(2).to_pylist()):
                of: dict[tuple[str, int], list[str]] = {}
                for kind, text in zip(kinds[start:], part, strict=False):
                    of.setdefault(kind, []).append(text)
                for kind, some in of.items():
                    keys, times = np.unique(windows(some)[0], return_counts=True)
                    held.setdefault(kind, []).append((keys, times.astype(np.int64)))
                    size += len(keys)
                    if len(held[kind]) > 16:
                        merged = _counted(*(np.concatenate([x[i] for x in held[kind]]) for i in (0, 1)))
                        size += len(merged[0]) - sum(len(k) for k, _ in held[kind])
                        held[kind] = [merged]
                if size > 4 * HELD:
                    yield from told()
                    size = 0
        yield from told()

    counted = rows.select("lang", "fold", "text").mapInArrow(run, "lang string, fold int, gram long, n long")
    outside = [F.sum(F.when(F.col("fold") != f, F.col("n")).otherwise(0)).alias(f"n_{f}") for f in range(FOLDS)]
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"), *outside)


@dataclass
class Model:
    """A language's sorted hash arrays: of each order the windows with their log probabilities, and the contexts with their back-off weights."""

    grams: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    floor: float

    def log_probability(self, grams: np.ndarray) -> np.ndarray:
        """log2 of the last letter's probability behind the three before it."""
        total = np.full(len(grams), self.floor)
        for n in range(1, ORDER + 1):
            if n > 1:
                at, met = _found(self.contexts[n - 1], mixed(_tail(grams, n) >> np.uint64(WIDE)))
                total[met] += self.weights[n - 1][at[met]]
            at, met = _found(self.grams[n - 1], mixed(_tail(grams, n)))
            total[met] = self.logs[n - 1][at[met]]
        return total


def _tail(grams: np.ndarray, n: int) -> np.ndarray:
    """The last n letters of windows."""
    return grams if n == ORDER else grams & np.uint64((1 << (WIDE * n)) - 1)


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def kneser_ney(grams: np.ndarray, counts: np.ndarray, alphabet: int) -> Model:
    """The model of one language from its distinct four-letter windows and their counts.

    Lower orders count the different letters that stand before a window; each order's
    discount follows from its windows counted once and twice.
    """
    by_order = {ORDER: _counted(grams, counts)}
    for n in range(ORDER - 1, 0, -1):
        keys = by_order[n + 1][0]
        by_order[n] = _counted(_tail(keys, n), np.ones(len(keys), np.int64))
    made: list[tuple[np.ndarray, ...]] = []
    floor, model = 0.0, None
    for n in range(1, ORDER + 1):
        keys, times = by_order[n]
        once, twice = int((times == 1).sum()), int((times == 2).sum())
        discount = once / (once + 2 * twice) if once and twice else 0.5
        context = keys >> np.uint64(WIDE)
        heads, which, followers = np.unique(context, return_inverse=True, return_counts=True)
        sums = np.bincount(which, times.astype(float), minlength=len(heads))
        weight = discount * followers / np.maximum(sums, 1)
        if n == 1:
            floor = float(np.log2(weight[0] / alphabet)) if len(weight) else -float(np.log2(alphabet))
            lower = np.full(len(keys), 1 / alphabet)
        else:
            lower = np.exp2(model.log_probability(keys))
        p = np.maximum(times - discount, 0) / np.maximum(sums, 1)[which] + weight[which] * lower
        by_gram, by_head = np.argsort(mixed(keys)), np.argsort(mixed(heads))
        made.append((mixed(keys)[by_gram], np.log2(p)[by_gram], mixed(heads)[by_head], np.log2(weight)[by_head]))
        none = (np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.uint64), np.zeros(0))
        model = Model(*(list(x) for x in zip(*made, *[none] * (ORDER - n), strict=True)), floor)
    return model


@dataclass
class Identifier:
    """Models of all languages, and what calibration made of them."""

    languages: list[str]
    models: list[Model]
    sharpness: float = 1.0
    usual: np.ndarray | None = None
    furthest: np.ndarray | None = None

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(bits a letter for each text and language, letters and separators of each text)."""
        bits, sizes = np.zeros((len(texts), len(self.models))), np.zeros(len(texts), np.int64)
        grams, owner = windows(texts)
        for k in range(0, len(grams), CHUNK):
            some, whose = grams[k : k + CHUNK], owner[k : k + CHUNK]
            sizes += np.bincount(whose, minlength=len(texts))
            bins = (mixed(some) >> np.uint64(64 - BINS)).astype(np.int64)
            kept = np.zeros(1 << BINS, np.uint64)
            kept[bins] = some
            odd = kept[bins] != some  # windows that share a bin with another are looked up apart
            used = np.flatnonzero(np.bincount(bins, minlength=1 << BINS))
            others, which = np.unique(some[odd], return_inverse=True)
            for j, model in enumerate(self.models):
                known = np.zeros(1 << BINS)
                known[used] = model.log_probability(kept[used])
                logs = known[bins]
                if len(others):
                    logs[odd] = model.log_probability(others)[which]
                bits[:, j] -= np.bincount(whose, logs, minlength=len(texts))
        return np.round(bits / np.maximum(sizes, 1)[:, None], 9), sizes

    def predict(self, bits: np.ndarray, sizes: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, accepted, bits of it) of each text; texts without letters have no language."""
        n = len(bits)
        if not self.models:
            return [UNKNOWN] * n, np.zeros(n), np.zeros(n, bool), np.zeros(n)
        best = bits.argmin(axis=1)
        least = bits[np.arange(n), best]
        odds = np.exp(-self.sharpness * (bits - least[:, None]) * np.sqrt(sizes)[:, None])
        spoken = sizes > 0
        beyond = (least - self.usual[best]) * np.sqrt(sizes) if self.usual is not None else np.zeros(n)
        accepted = spoken & (beyond <= self.furthest[best] if self.furthest is not None else True)
        return [self.languages[b] if s else UNKNOWN for b, s in zip(best, spoken, strict=True)], np.where(spoken, 1 / odds.sum(axis=1), 0.0), accepted, least

    def calibrate(self, told: DataFrame, rejected: float) -> None:
        """The sharpness that makes scores of all ``told`` texts likeliest, and how far the given share of each language's texts lies at most; ``told`` is of :func:`_told`."""
        whole = told.agg(F.count("*").alias("n"), *(F.sum(F.col("losses")[k]).alias(f"g{k}") for k in range(len(GRID)))).first()
        if not whole.n:
            return
        self.sharpness = float(GRID[np.argmin(whole[1:])])
        spread = {r.lang: r.spread / SCALE for r in told.groupBy("lang").agg(F.round(F.stddev_pop("own"), 3).alias("spread")).collect()}  # a row a language
        usual = quantiles(told.select("lang", F.col("own").alias("value")), 0.5)
        beyond = F.round((F.col("own") - _of(usual, "double")) * F.sqrt("size")).cast("long")
        most = quantiles(told.select("lang", beyond.alias("value")), 1 - rejected)
        self.usual = np.array([usual.get(x, 0.0) / SCALE for x in self.languages])
        self.furthest = np.array([most[x] / SCALE + np.sqrt(20) * max(spread[x], 0.1) if x in most else np.inf for x in self.languages])


#: A model as a row; its arrays are the bytes of their numbers.
MODEL = "lang string, grams array<binary>, logs array<binary>, contexts array<binary>, weights array<binary>, floor double"


def fitted(rows: DataFrame, bits: int = 20, rejected: float = 0.005, most_mb: int = 1_024) -> Identifier:
    """The identifier of ``rows`` (id, lang, text), every one of which is counted and calibrated on.

    Counts cover all windows of all texts.  A language's model keeps, of windows that
    meet in one of 2 ** ``bits`` places, the commonest with the counts of all, so it has at most
    that many of each order and as many contexts, 128 bytes together, whatever the corpus.  Models are built in tasks, one a
    language, and only then sent; languages whose models could need more than ``most_mb``
    are refused before.

    For calibration the texts are dealt to FOLDS parts by a hash, and each one is scored by
    models of all the other parts, a part at a time; a text whose language no other part has
    tells nothing.  ``rejected`` is the share of a language's own texts that would be refused.
    The models that are returned have the counts of all.
    """
    rows = rows.withColumn("fold", F.pmod(F.xxhash64(F.lit(5), "id", "text"), F.lit(FOLDS)).cast("int"))
    counts = written(window_counts(rows), "windows")
    slot = F.shiftrightunsigned(F.xxhash64("gram"), 64 - bits)
    merged = [x for n in ("n", *(f"n_{f}" for f in range(FOLDS))) for x in (F.max_by("gram", F.struct(n, "gram")).alias(f"gram_{n}"), F.sum(n).alias(n))]
    places = written(counts.groupBy("lang", slot.alias("slot")).agg(*merged), "places")
    sizes = [r.n for r in places.groupBy("lang").agg(F.count("*").alias("n")).collect()]  # a row a language
    if 128 * sum(sizes) > most_mb << 20:
        raise ValueError(f"models of {len(sizes)} languages may need more than {most_mb} MB; take fewer bits")
    letters = places.select(F.expr("gram_n & 65535").alias("letter")).distinct().count()
    told = [x for f in range(FOLDS) if (x := _told(rows.where(F.col("fold") == f), _built(places, f"n_{f}", letters))) is not None]
    found = _built(places, "n", letters)
    if told:
        found.calibrate(reduce(DataFrame.unionByName, told), rejected)
    return found


def _built(places: DataFrame, n: str, letters: int) -> Identifier:
    """Models of the counts that the column ``n`` of the places has, a task for each language, brought together as arrays."""

    def build(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        model = kneser_ney(group.column("gram").to_numpy().view(np.uint64), group.column("n").to_numpy(), letters + 1)
        arrays = {name: [x.tobytes() for x in getattr(model, name)] for name in ("grams", "logs", "contexts", "weights")}
        return pa.Table.from_pylist([{"lang": key[0].as_py()} | arrays | {"floor": model.floor}])

    counted = places.where(F.col(n) > 0).select("lang", F.col(f"gram_{n}").alias("gram"), F.col(n).alias("n"))
    built = counted.groupBy("lang").applyInArrow(build, MODEL).orderBy("lang").toArrow()
    read = lambda r, name, kind: [np.frombuffer(x, kind) for x in r[name]]
    models = [Model(read(r, "grams", np.uint64), read(r, "logs", float), read(r, "contexts", np.uint64), read(r, "weights", float), r["floor"]) for r in built.to_pylist()]
    return Identifier(built.column("lang").to_pylist(), models)


def _told(rows: DataFrame, model: Identifier) -> DataFrame | None:
    """(lang, size, own, losses) of the texts that have letters and a language of the model, written; none without models.

    ``own`` are the bits a letter in the text's own language, times SCALE, and ``losses``
    the negative log of its share of the odds for each sharpness of GRID.
    """
    if not model.models:
        return None
    sent = rows.sparkSession.sparkContext.broadcast(model)  # bounded by fitted()
    place = {lang: k for k, lang in enumerate(model.languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            truths = np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)
            for start, part in _parts(batch.column(1).to_pylist()):
                bits, sizes = sent.value.entropies(part)
                own = bits[np.arange(len(part)), truths[start : start + len(part)]]
                gap = (bits - own[:, None]) * np.sqrt(sizes)[:, None]
                losses = np.stack([np.log(np.exp(np.clip(-g * gap, -700, 700)).sum(axis=1)) for g in GRID], axis=1)
                whole = np.rint(own * SCALE).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), pa.array(sizes), pa.array(whole), pa.array(losses.tolist(), pa.list_(pa.float64()))], ["lang", "size", "own", "losses"])

    known = rows.where(F.col("lang").isin(model.languages)).select("lang", "text")
    told = written(known.mapInArrow(run, "lang string, size long, own long, losses array<double>").where("size > 0"), "told")
    sent.destroy()
    return told


def _of(values: dict[str, float] | dict[str, list[int]], kind: str) -> Column:
    """The constant of type ``kind`` that each row's ``lang`` has."""
    return F.create_map(*(x for lang, value in values.items() for x in (F.lit(lang), F.lit(value).cast(kind))))[F.col("lang")]


def quantiles(rows: DataFrame, share: float) -> dict[str, float]:
    """The exact quantile of ``value`` (long) of each ``lang``, in proportion between the two values that it lies between.

    Both are found by their leading bits, DIGITS more in each pass: counts alone are moved,
    at most 2 ** (DIGITS + 1) for a language and pass, and no task holds a language's values.
    """
    ends = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most")).collect()
    if not ends:
        return {}
    least, places = {r.lang: r.least for r in ends}, {r.lang: share * (r.n - 1) for r in ends}
    rows = rows.select("lang", (F.col("value") - _of(least, "long")).alias("value"))
    # (language, rank) -> (leading bits that are known, rank among the values that have them)
    at = {(lang, side(place)): (0, side(place)) for lang, place in places.items() for side in (math.floor, math.ceil)}
    wide = max(r.most - r.least for r in ends).bit_length()
    for shift in reversed(range(0, wide, DIGITS)):
        some = rows
        if shift + DIGITS < wide:
            known: dict[str, list[int]] = {}
            for (lang, _), (bits, _) in at.items():
                known.setdefault(lang, []).append(bits)
            some = rows.where(F.array_contains(_of(known, "array<long>"), F.shiftright("value", shift + DIGITS)))
        counts: dict[tuple[str, int], list[tuple[int, int]]] = {}
        for lang, bits, n in some.groupBy("lang", F.shiftright("value", shift)).count().collect():
            counts.setdefault((lang, bits >> DIGITS), []).append((bits, n))
        for (lang, rank), (known_bits, left) in at.items():
            for bits, n in sorted(counts[lang, known_bits]):
                if left < n:
                    at[lang, rank] = bits, left
                    break
                left -= n

    def quantile(lang: str, place: float) -> float:
        low, high = (least[lang] + at[lang, side(place)][0] for side in (math.floor, math.ceil))
        return low + (place - math.floor(place)) * (high - low)

    return {lang: quantile(lang, place) for lang, place in places.items()}


def identified(docs: DataFrame, model: Identifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, accepted, bits) of every row's whole text.

    ``lang_pred`` is the language of least cross-entropy, of equal ones the first by
    name; ``und`` for null texts, texts without a letter, and without any model.  ``score``
    is its share of the calibrated odds, 0 for ``und``.  ``accepted`` says whether the
    cross-entropy (``bits`` a letter) is one that texts of that language have.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in _parts(batch.column(1).to_pylist()):
                lang, score, accepted, least = sent.value.predict(*sent.value.entropies(part))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), pa.array(lang), pa.array(score), pa.array(accepted), pa.array(least)], ["id", "lang_pred", "score", "accepted", "bits"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double, accepted boolean, bits double")


def identify(docs: DataFrame, may_learn: str = "true", id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> tuple[DataFrame, Identifier]:
    """(:func:`identified` of all rows, the model), learned from rows with text and language for which the SQL ``may_learn`` holds.

    Rows that repeat an id teach each and are identified each; a null id does neither harm.
    An empty table gives no rows; without rows to learn from every text is ``und``.
    """
    known = docs.where(may_learn).where(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull())
    rows = known.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    model = fitted(rows, **options)
    return identified(docs, model, id_col, text_col), model
