"""Periodic runs: stretches of words that repeat with a period, found inside each text.

A run of period q has at least ``times * q`` words, so each of its words occurs at least ``times``
times in it. Words rarer than that in a segment split it; the parts are counted anew until nothing
splits. The surviving segments are scanned lag by lag: words that equal those q places on make up a
run, and a stretch of them that is long enough covers a whole block of a grid, so only the blocks'
first words are compared for all lags, then the next words of those that agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewatch.llm.common import bytes_of

#: Columns that ``find_runs`` adds, and their types.
ADDED = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
#: Grid places compared at once; bytes of collapsed text handed on at once.
PLACES, HANDED = 1 << 20, 16 << 20

Run = tuple[int, int, int]


def frequent_segments(ids: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """The ``(start, end)`` that remain once rare words have split them until none is rare."""
    place = np.flatnonzero(np.bincount(ids)[ids] >= times)
    while len(place):
        cuts = np.flatnonzero(np.diff(place) > 1) + 1
        starts = np.concatenate([[0], cuts])
        sizes = np.diff(np.concatenate([starts, [len(place)]]))
        long = sizes >= least
        if not long.all():
            place = place[np.repeat(long, sizes)]
            starts, sizes = starts[long], sizes[long]
            starts = np.cumsum(sizes) - sizes
        if not len(place):
            break
        segment = np.repeat(np.arange(len(sizes)), sizes)
        word = segment * (int(ids.max()) + 1) + ids[place]
        _, which, counts = np.unique(word, return_inverse=True, return_counts=True)
        enough = counts[which] >= times
        if enough.all():
            return [(int(place[s]), int(place[s]) + int(m)) for s, m in zip(starts, sizes, strict=True)]
        place = place[enough]
    return []


def _agreeing(x: np.ndarray, at: int, step: int, lag: int) -> int:
    """How many places from ``at`` on, in the direction of ``step``, equal those ``lag`` later."""
    done, width = 0, 64
    room = len(x) - lag - at if step > 0 else at + 1
    while done < room:
        width = min(2 * width, room - done)
        if step > 0:
            here = x[at + done:at + done + width] == x[at + lag + done:at + lag + done + width]
        else:
            stop = at - done + 1
            here = (x[stop - width:stop] == x[stop - width + lag:stop + lag])[::-1]
        if not here.all():
            return done + int(np.argmin(here))
        done += width
    return done


def lag_scan(x: np.ndarray, least: int, times: int) -> list[Run]:
    """All runs of a segment, by rising lag, so that a smallest period comes before its multiples."""
    found: list[Run] = []
    lags = np.arange(1, len(x) // times + 1)
    blocks = (np.maximum(least - lags, (times - 1) * lags) + 1) // 2
    counts = (len(x) - lags) // blocks
    ends = np.cumsum(counts)
    first = 0
    while first < len(lags):
        base = int(ends[first - 1]) if first else 0
        last = max(int(np.searchsorted(ends, base + PLACES, "right")), first + 1)
        own = slice(first, last)
        lag, block = (np.repeat(v[own], counts[own]) for v in (lags, blocks))
        at = (np.arange(len(lag)) - np.repeat(ends[own] - counts[own] - base, counts[own])) * block
        for k in range(32):
            same = (x[np.minimum(at + k, len(x) - lag - 1)] == x[np.minimum(at + k + lag, len(x) - 1)]) | (k >= block)
            at, lag, block = at[same], lag[same], block[same]
            if not len(at):
                break
        open_ = np.ones(len(at), bool)
        for start, length, period in found:
            open_ &= ~((lag % period == 0) & (at >= start) & (at + block + lag <= start + length))
        for k in range(len(at)):
            if not open_[k]:
                continue
            q = int(lag[k])
            low = int(at[k]) - _agreeing(x, int(at[k]) - 1, -1, q)
            high = int(at[k]) + _agreeing(x, int(at[k]), 1, q)
            open_ &= ~((lag == q) & (at >= low) & (at < max(high, int(at[k]) + 1)))
            length = high + q - low
            # a block that reaches beyond a run opens at multiples of its period, and spans that run again
            again = any(q % period == 0 and start <= low and low + length <= start + n for start, n, period in found)
            if high > low and length >= max(least, times * q) and not again:
                found.append((low, length, q))
                open_ &= ~((lag % q == 0) & (at >= low) & (at + block + lag <= low + length))
        first = last
    return found


def periodic_runs(ids: np.ndarray, least: int = 24, times: int = 3) -> list[Run]:
    """``(start, length, period)`` by start, then period, of the maximal runs of a word sequence."""
    if len(ids) < least:
        return []
    return sorted((low + start, length, period) for low, high in frequent_segments(ids, least, times)
                  for start, length, period in lag_scan(ids[low:high], least, times))


def _finder(least: int, times: int, text_at: int, kept: list[int], names: list[str]):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes: list[int] = []
            found: list[list[dict]] = []
            texts: list[bytes] = []
            since = held = 0

            def handed(upto: int, batch=batch, sizes=sizes, found=found, texts=texts):
                new = [pa.array(sizes, pa.int64()), pa.array(found, kind), pa.array(texts, pa.binary()).cast(pa.string())]
                old = batch.slice(since, upto - since)
                return pa.record_batch([old.column(k) for k in kept] + new, names)  # noqa: B023

            for row, text in enumerate(bytes_of(batch.column(text_at)), 1):
                words = text.split() if text else []
                sizes.append(len(words))
                runs: list[Run] = []
                if len(words) >= least:
                    number: dict[bytes, int] = {}
                    ids = np.array([number.setdefault(w, len(number)) for w in words])
                    runs = periodic_runs(ids, least, times)
                    if runs:
                        stays = np.ones(len(words), bool)
                        for start, length, period in runs:
                            stays[start + period:start + length] = False
                        words = [words[k] for k in np.flatnonzero(stays).tolist()]
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                texts.append(b" ".join(words))
                held += len(texts[-1])
                if held >= HANDED:
                    yield handed(row)
                    since, held = row, 0
                    for done in (sizes, found, texts):
                        done.clear()
            if sizes:
                yield handed(batch.num_rows)

    return run


def find_runs(docs: DataFrame, least: int = 24, times: int = 3, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` and ``collapsed``, the text without the repeats.

    A run is a stretch of consecutive words with smallest period q and ``max(least, times * q)``
    words or more that neither neighbour extends; ``times`` is 2 or more. A word goes if any run
    holds it after the run's first q words; the rest stands joined by one space. Words are runs of
    bytes other than ASCII white space. A null or empty text has no words, no runs and an empty
    ``collapsed``; rows are judged one by one, so repeated rows and ties need no rule, and an empty
    table gives no row. Columns of ``docs`` that are called like the three are replaced; ``keep``
    names the columns to hand on (all by default). Whole texts are read, whatever their length; a
    worker holds one batch of them.
    """
    added = [part.split()[0] for part in ("n_words long", "runs array", "collapsed string")]
    wanted = docs.columns if keep is None else keep
    kept = [name for name in wanted if name.lower() not in added]
    read = docs.select(*dict.fromkeys([*[f"`{name}`" for name in kept], "`text`"]))
    fields = ", ".join(f"`{name}` {docs.schema[name].dataType.simpleString()}" for name in kept)
    names = [*kept, *added]
    places = [read.columns.index(name) for name in kept]
    finder = _finder(least, times, read.columns.index("text"), places, names)
    return read.mapInArrow(finder, f"{fields}, {ADDED}" if fields else ADDED)
