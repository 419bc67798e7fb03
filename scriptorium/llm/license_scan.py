"""Licence scans: Dice coefficient over word bigrams against licence templates.

Text is normalised to lower-case words of letters and digits, `licence` read as
`license`. Compared are all runs of consecutive paragraphs (one, several, the whole
text), the lines and their sentences, and windows of any other bounds, each as a set of
word bigrams. A unit matches a template if 2 |A and B| / (|A| + |B|) reaches the
threshold. A unit of n bigrams can only reach it for templates of t/(2-t) n to (2-t)/t n
bigrams, and must share one of the few rarest bigrams of such a template; other templates
are not compared. Nor are those of which the whole text shares too little, and runs in a
stretch that does. The bounds are exact, so nothing that matches is lost.

Windows go from the start of a stretch of a template's bigrams to the end of one: those
are the best of all windows, since a bigram of the template beside a window can only
raise its score. So a notice wrapped between lines of prose, or named within a sentence,
is found. Of windows that overlap, or lie over a matching unit, the best stands. Runs that
differ only by repeats are counted together, so work and memory follow the length of a text,
however often it repeats a notice.

A row of the result is a document: its best licence (highest score, then the
licence that sorts first), that score, all licences found, and the number of
matching units and windows, where a unit that holds or lies in another matching one counts
too, so a long licence of many paragraphs counts for each of its runs that match. Null
or empty text has none: null licence, score 0. Very long texts are scanned whole. Other
columns do not matter, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, OrderedDict
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import small_batches, table, worker_cache
from .license_templates import templates

DICE = 0.8
_WORD = re.compile(r"[^\W_]+")
_PARAGRAPH, _SENTENCE = re.compile(r"\n\s*\n"), re.compile(r"(?<=[.!?;])\s+")


def words_of(text: str) -> list[str]:
    return [x if x != "licence" and x != "licences" and x != "licenced" else x.replace("licenc", "licens") for x in _WORD.findall(text.lower())]


def bigrams_of(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:]))


def dice(a: set, b: set) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


class Scanner:
    def __init__(self, threshold: float = DICE, known: list[tuple[str, str]] | None = None):
        self.threshold = threshold
        self.known = [(name, b) for name, text in (known or templates()) if (b := bigrams_of(words_of(text)))]
        use = Counter(x for _, b in self.known for x in b)
        #: rare bigram -> templates of which a matching unit shares it or another of their rare ones
        self.rare: dict[tuple[str, str], list[int]] = {}
        #: bigrams that a match shares with each template at least
        self.least = [-int(-(threshold / (2 - threshold) * len(b) - 1e-9) // 1) for _, b in self.known]
        for k, (_, b) in enumerate(self.known):
            for x in sorted(b, key=lambda x: (use[x], x))[: len(b) - self.least[k] + 1]:
                self.rare.setdefault(x, []).append(k)

    def among(self, found: set[tuple[str, str]]) -> list[int]:
        """Templates that a unit may match whose bigrams are all among those found."""
        candidates = sorted({k for x in found if x in self.rare for k in self.rare[x]})
        return [k for k in candidates if len(found) >= self.least[k] and len(found & self.known[k][1]) >= self.least[k]]

    def unit(self, words: list[str], among: list[int]) -> list[tuple[float, str]]:
        """(score, licence) of the templates that a unit matches."""
        found = bigrams_of(words)
        low, high = self.threshold / (2 - self.threshold) * len(found), (2 - self.threshold) / self.threshold * len(found)
        scores = ((dice(found, self.known[k][1]), self.known[k][0]) for k in among if low - 1e-9 <= len(self.known[k][1]) <= high + 1e-9)
        return [x for x in scores if x[0] >= self.threshold - 1e-12]

    def runs(self, pairs: list[list[tuple[str, str]]], k: int) -> Iterator[tuple[int, int, int, float]]:
        """(first, least end, end, score): runs of paragraphs that match a template, those from one paragraph with the same bigrams together.

        pairs: the bigrams of each paragraph, that with the word before it first. A window of as many
        paragraphs as the size bound allows goes along; only where it shares enough are runs compared.
        From the last paragraph to the first, `next_in` holds the bigrams in the order in which they
        come next, so what a run has more than a shorter one is read off, however often texts repeat.
        """
        known = self.known[k][1]
        high, inside, shared, j = (2 - self.threshold) / self.threshold * len(known) + 1e-9, Counter(), 0, 0
        starts = set()
        for i, own in enumerate(pairs):
            j = max(i, j)
            while j < len(pairs) and len(inside) <= high:
                for x in pairs[j] if j > i else pairs[j][1:]:
                    inside[x] += 1
                    shared += inside[x] == 1 and x in known
                j += 1
            if shared >= self.least[k]:
                starts.add(i)
            # the next window begins with the next paragraph, without the bigram that leads into it
            for x in own[1:] + (pairs[i + 1][:1] if i + 1 < j else []):
                inside[x] -= 1
                if not inside[x]:
                    del inside[x]
                    shared -= x in known
        next_in: OrderedDict[tuple[str, str], int] = OrderedDict()
        for i in range(len(pairs) - 1, -1, -1) if starts else ():
            for x in pairs[i][1:]:
                next_in[x] = i
                next_in.move_to_end(x, last=False)
            if i in starts:
                size = both = 0
                at = i
                for x, of in next_in.items():
                    if of != at:
                        if (score := 2 * both / (size + len(known))) >= self.threshold - 1e-12:
                            yield i, at + 1, of, score
                        at = of
                    size += 1
                    if size > high:
                        break
                    both += x in known
                else:
                    if (score := 2 * both / (size + len(known))) >= self.threshold - 1e-12:
                        yield i, at + 1, len(pairs), score
            next_in[pairs[i][0]] = i
            next_in.move_to_end(pairs[i][0], last=False)

    def windows(self, bigrams: list[tuple[str, str]], k: int) -> Iterator[tuple[float, int, int]]:
        """(score, first word, end) of the best window that matches a template, from each stretch of its bigrams.

        Windows whose first stretch recurs in them say nothing that those from the next stretch
        do not, and are left out; so a repeated text is compared with its next repeat, not with all.
        """
        known, least = self.known[k][1], self.least[k]
        hits = [i for i, x in enumerate(bigrams) if x in known]
        if len(hits) < least:
            return
        starts = [i for j, i in enumerate(hits) if not j or hits[j - 1] != i - 1]
        high, every, stop = (2 - self.threshold) / self.threshold * len(known) + 1e-9, len({bigrams[i] for i in hits}), hits[-1] + 1
        # the longest window of each start that the size bound allows must share enough
        inside, shared, j, dense, wanted = Counter(), 0, hits[0], set(), set(starts)
        for i in range(hits[0], stop):
            while j < stop and len(inside) <= high:
                inside[bigrams[j]] += 1
                shared += inside[bigrams[j]] == 1 and bigrams[j] in known
                j += 1
            if shared >= least and i in wanted:
                dense.add(i)
            inside[bigrams[i]] -= 1
            if not inside[bigrams[i]]:
                del inside[bigrams[i]]
                shared -= bigrams[i] in known
        if not dense:
            return
        next_at: OrderedDict[tuple[str, str], int] = OrderedDict()
        for i in reversed(starts):
            again = max(next_at.get(bigrams[p], len(bigrams)) for p in range(i, stop))
            for p in range(stop - 1, i - 1, -1):
                next_at[bigrams[p]] = p
                next_at.move_to_end(bigrams[p], last=False)
            stop, size, both, best = i, 0, 0, (self.threshold - 1e-12, -1, -1)
            for x, p in next_at.items() if i in dense else ():
                size += 1
                if p >= again or size > high:
                    break
                if x in known:
                    both += 1
                    if both >= least and (score := 2 * both / (size + len(known))) > best[0]:
                        best = score, i, p + 2
                elif 2 * every / (size - both + every + len(known)) < best[0]:  # not even all that is left makes up for the rest
                    break
            if best[2] > 0:
                yield best

    def pieces(self, text: str) -> tuple[list[str], list[tuple[int, int]], list[int]]:
        """The words of a text, the runs of its sentences and lines, and where its paragraphs end."""
        pieces, ends = [], {1: [0], 2: [0], 3: [0]}
        for paragraph in _PARAGRAPH.split(text):
            for line in paragraph.split("\n"):
                for sentence in _SENTENCE.split(line):
                    pieces.append(words_of(sentence))
                    ends[3].append(len(pieces))
                ends[2].append(len(pieces))
            ends[1].append(len(pieces))
        at = [0, *accumulate(map(len, pieces))]
        small = dict.fromkeys((at[a], at[b]) for level in (3, 2) for a, b in zip(ends[level], ends[level][1:]) if at[b] - at[a] > 1)
        return [w for p in pieces for w in p], list(small), sorted({at[x] for x in ends[1]})

    def units(self, text: str) -> Iterator[list[str]]:
        """The words of a text's sentences, lines and runs of paragraphs, each run of words once."""
        words, small, at = self.pieces(text)
        for a, b in dict.fromkeys([*small, *((a, b) for i, a in enumerate(at) for b in at[i + 1 :] if b - a > 1)]):
            yield words[a:b]

    def matches(self, text: str) -> Iterator[tuple[float, str, int]]:
        """(score, licence, how many) of the matching units, each by its best template, then of the matching windows beside them."""
        words = words_of(text)
        if self.rare.keys().isdisjoint(zip(words, words[1:])) or not (among := self.among(bigrams_of(words))):
            return
        words, small, at = self.pieces(text)
        found = {x: self.unit(words[x[0] : x[1]], among) for x in small}
        taken = [x for x, y in found.items() if y]
        for y in found.values():
            if y:
                yield *min(y, key=lambda z: (-z[0], z[1])), 1
        pairs = [[(words[a - 1] if a else "", words[a]), *zip(words[a:b], words[a + 1 : b])] for a, b in zip(at, at[1:])]
        large: dict[int, list] = {}
        for k in among:
            for i, low, high, score in self.runs(pairs, k):
                large.setdefault(i, []).append((low, high, -score, self.known[k][0]))
        ends = {x: i for i, x in enumerate(at)}
        known_ends: dict[int, set[int]] = {}  # runs of paragraphs that are lines or sentences as well
        for a, b in found:
            if a in ends and b in ends:
                known_ends.setdefault(ends[a], set()).add(ends[b])
        for i in sorted(large):
            spans = large[i]
            taken += [(at[i], at[high]) for _, high, *_ in spans]
            # between two bounds the same spans hold, so the best is the same
            bounds = sorted({x for low, high, *_ in spans for x in (low, high + 1)})
            same = sorted(known_ends.get(i, ()))
            for low, stop in zip(bounds, bounds[1:]):
                best = min(((score, name) for a, b, score, name in spans if a <= low <= b), default=None)
                if best and (n := stop - low - (bisect_left(same, stop) - bisect_left(same, low))):
                    yield -best[0], best[1], n
        first, last = [], []  # bounds of what is taken, apart from one another
        for a, b in sorted(taken):
            if last and a <= last[-1]:
                last[-1] = max(b, last[-1])
            else:
                first.append(a)
                last.append(b)
        bigrams = list(zip(words, words[1:]))
        for score, name, i, j in sorted(((-score, self.known[k][0], i, j) for k in among for score, i, j in self.windows(bigrams, k))):
            n = bisect_right(last, i)
            if n == len(last) or first[n] >= j:
                first.insert(n, i)
                last.insert(n, j)
                yield -score, name, 1

    def scan(self, text: str) -> list[tuple[float, str]]:
        """matches(), each as often as it occurs."""
        return [(score, name) for score, name, n in self.matches(text) for _ in range(n)]


def _scanned(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("license_scan")
        scanner = Scanner(threshold)
        for batch in batches:
            found, sums = [], []
            for text in batch.column(1).to_pylist():
                kept: dict[str, float] = {}
                total = 0
                for score, name, n in scanner.matches(text or ""):
                    kept[name] = max(score, kept.get(name, 0.0))
                    total += n
                found.append(kept)
                sums.append(total)
            best = [min(((-score, name) for name, score in x.items()), default=(-0.0, None)) for x in found]
            columns = [pa.array([x[1] for x in best], pa.string()), pa.array([abs(x[0]) for x in best], pa.float64()), pa.array([sorted(x) for x in found], pa.list_(pa.string())), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "license", "score", "licenses", "n_matches"])

    return run


def license_scan(docs: DataFrame, threshold: float = DICE) -> DataFrame:
    """doc_id, license, score, licenses, n_matches of each document (doc_id, text)."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("license string, score double, licenses array<string>, n_matches long").fields])
    return docs.mapInArrow(_scanned(threshold), schema)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
