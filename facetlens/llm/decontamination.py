"""Benchmark decontamination: a BM25 index of the test items, block-max WAND, overlap checks.

Every training passage (windows of twice the longest item's words, half overlapping, over whole texts) is
a query. A term's weight in an item is its BM25 impact as a share of the item's total, so the score of an
item that is wholly inside a passage is 1. A passage none of whose blocks of items can reach the threshold,
by its terms' largest weights anywhere or in the block, is left at once. For the others the posting lists
of their terms (items ascending) are walked by block-max WAND: the pivot is the first item at which the
lists' largest weights reach the threshold; if the largest weights in its block reach it too, the item is
scored, else the lists skip to the block's end or the next list's item. All items with a score of at least ``threshold`` are checked: of the five-word shingles of
the question and of the answer, ``overlap`` of each must be in the document. A part of at most eight words
has so few shingles that one changed word breaks them all; so many of its words may instead be, in order,
in the document beside a place of the other part. Words are what signs and white space part, so signs
glued to an item's ends, in it or in the document, do not hide it; words of signs alone stay whole.

Document frequencies, mean length and the longest item are those of all items, counted by Spark. Items are
indexed in groups of bounded bytes, each built by a task as a file in the shared folder, which the tasks
over the documents read: one pass over the documents a group, and the same results whatever the groups. An
item's answer is what follows its last question mark; without one, its last sentence; of a single
sentence, its last third. Null, empty and blank texts and items match nothing; items with a null item_id
are not looked for. Document rows with a null doc_id are searched like others. Repeated rows of documents
give repeated results, repeated rows of items count once. Empty tables give no row.
"""

from __future__ import annotations

import math
import pickle
import re
import unicodedata
import uuid
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetlens.llm.common import Words, runs, shared_dir, shingles, stage, text_slices

K1, B = 1.2, 0.75
#: Items of a block (so few that its maxima are near the scores), and bytes of items that are indexed together.
BLOCK, GROUP_BYTES = 4, 8 << 20
SHINGLE = 5
#: Parts of up to so many words are also sought beside the other part, at most SHINGLE words off their place.
SHORT = 2 * (SHINGLE - 1)


class _Signs(dict):
    """Punctuation and symbols to spaces, for str.translate; marks that belong to letters stay."""

    def __missing__(self, code: int) -> int:
        self[code] = 0x20 if unicodedata.category(chr(code))[0] in "PS" else code
        return self[code]


_SIGNS = _Signs()


def bare_words(texts: pa.Array) -> Words:
    """Words of the texts, parted by signs too."""
    words, number, flat, size = Words(texts), {}, [], []
    for value in words.values:
        own = [value] if value.isalnum() else value.decode().translate(_SIGNS).encode().split() or [value]
        flat += [number.setdefault(p, len(number)) for p in own]
        size.append(len(own))
    if len(words.codes):
        size = np.array(size, np.int64)
        n, begin = size[words.codes], (np.cumsum(size) - size)[words.codes]
        ends = np.concatenate([[0], np.cumsum(n)])
        words.codes = np.array(flat, np.int64)[np.repeat(begin - ends[:-1], n) + np.arange(ends[-1])]
        words.off, words.values = ends[words.off], list(number)
    return words


def _in_order(part: np.ndarray, near: np.ndarray) -> int:
    """Words of ``part`` that are, in order, in ``near``."""
    row = [0] * (len(near) + 1)
    for a in part.tolist():
        new = [0]
        for j, b in enumerate(near.tolist()):
            new.append(row[j] + 1 if a == b else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def _beside(part: np.ndarray, starts: np.ndarray, text: np.ndarray, enough: float) -> float:
    """The largest share of ``part``'s words found at one of ``starts`` in ``text``, or the first of ``enough``."""
    best = 0.0
    for at in np.unique(starts).tolist():
        near = text[max(0, at - SHINGLE):max(0, at + len(part) + SHINGLE)]
        if np.isin(part, near).mean() > best:
            best = max(best, _in_order(part, near) / len(part))
        if best >= enough:
            break
    return best


def parts(text: str) -> tuple[str, str]:
    """Question and answer of an item."""
    if "?" in text[:-1] and text.rsplit("?", 1)[1].strip():
        head, tail = text.rsplit("?", 1)
        return head, tail
    ends = [m.end() for m in re.finditer(r"[.!?](?=\s)", text.rstrip())]
    if ends:
        return text[:ends[-1]], text[ends[-1]:]
    words = text.split()
    cut = len(words) - max(1, len(words) // 3)
    return " ".join(words[:cut]), " ".join(words[cut:])


class Index:
    """Posting lists of the items' terms, with the maxima that bound a passage's score.

    ``known``: words in the order of bytes and the number of items that hold each; ``total``, ``mean`` and
    ``longest``: items with words, their mean words and the most words. Without them these are the items' own.
    """

    def __init__(self, items: list[tuple[int, str]], known: tuple[list[bytes], list[int]] | None = None, total: int = 0, mean: float = 0.0, longest: int = 0):
        self.items = sorted((i, t) for i, t in items if t and t.split())
        n = len(self.items)
        words = bare_words(pa.array([t for _, t in self.items], pa.string()))
        self.term = {w: k for k, w in enumerate(words.values)}
        owner = words.owner()
        order = np.lexsort((owner, words.codes))
        item, term = owner[order], words.codes[order]
        first = runs(term, item)
        tf = np.diff(np.append(first, len(item)))
        item, term = item[first], term[first]
        df = np.bincount(term, minlength=len(self.term))
        if known is None:
            total, mean, longest = n, len(owner) / max(1, n), int(words.counts.max()) if n else 0
        else:
            for w, c in zip(*known):
                df[self.term[w]] = c
        self.longest = longest
        idf = np.log1p((total - df + 0.5) / (df + 0.5))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * words.counts[item] / max(1.0, mean)))
        weight = weight / np.bincount(item, weight, max(n, 1))[item] if n else weight
        #: Item and weight of each posting, by term and item; where each term's begin.
        self.post, self.weight = item, weight
        self.begin = np.searchsorted(term, np.arange(len(self.term) + 1))
        # The largest weight of each (term, block) that occurs, a term's blocks one after the other.
        self.blocks = -(-n // BLOCK)
        key = term * max(1, self.blocks) + item // BLOCK
        first = runs(key)
        self.keys = key[first]
        self.top = np.maximum.reduceat(weight, first) if len(first) else np.zeros(0)
        self.highest = np.zeros(len(self.term))
        np.maximum.at(self.highest, term, weight)
        self.row = np.searchsorted(self.keys, np.arange(len(self.term) + 1) * max(1, self.blocks))
        self.sides: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def parts_of(self, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Shingle hashes and word hashes of an item's question and answer."""
        if k not in self.sides:
            out = []
            for part in parts(self.items[k][1]):
                own = bare_words(pa.array([part], pa.string()))
                out.append((shingles(own, SHINGLE)[0], own.hashes()[own.codes] if len(own.codes) else np.zeros(0, np.uint64)))
            self.sides[k] = out
        return self.sides[k]

    def passages(self, words: Words):
        """(passage, term) once each, sorted, and the text of each passage."""
        size, step = 2 * self.longest, self.longest
        known = np.fromiter((self.term.get(w, -1) for w in words.values), np.int64, len(words.values))
        code = known[words.codes] if len(words.codes) else np.zeros(0, np.int64)
        count = words.counts
        number = np.where(count > 0, np.maximum(1, -(-(count - step) // step)), 0)
        base = np.cumsum(number) - number
        owner = words.owner()
        place = np.arange(len(code)) - words.off[:-1][owner]
        last = number[owner] - 1
        one = np.minimum(place // step, last)
        both = (place // step >= 1) & (place // step <= last)
        passage = np.concatenate([base[owner] + one, (base[owner] + place // step - 1)[both]])
        term = np.concatenate([code, code[both]])
        keep = term >= 0
        pair = np.unique(passage[keep] * len(self.term) + term[keep]) if keep.any() else np.zeros(0, np.int64)
        return pair // max(1, len(self.term)), pair % max(1, len(self.term)), np.repeat(np.arange(len(count)), number)

    def reachable(self, passage: np.ndarray, term: np.ndarray, least: float) -> np.ndarray:
        """Which rows are of passages with a block whose maxima add up to ``least``."""
        first = runs(passage)
        use = np.repeat(np.add.reduceat(self.highest[term], first) >= least, np.diff(np.append(first, len(passage))))
        rows = np.flatnonzero(use)
        stops = np.append(runs(passage[rows]), len(rows))
        # So many rows at a time that what a term spreads to stays small.
        step = max(1, (1 << 21) // max(1, self.blocks))
        out, at = np.zeros(len(passage), bool), 0
        while at < len(stops) - 1:
            to = max(at + 1, int(np.searchsorted(stops, stops[at] + step, "right")) - 1)
            own = rows[stops[at]:stops[to]]
            at = to
            t = term[own]
            number = np.cumsum(np.append(0, passage[own][1:] != passage[own][:-1]))
            n = self.row[t + 1] - self.row[t]
            row = np.repeat(self.row[t] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            bound = np.bincount(np.repeat(number, n) * self.blocks + self.keys[row] % self.blocks, self.top[row], (number[-1] + 1) * self.blocks)
            out[own] = (bound.reshape(-1, self.blocks).max(axis=1) >= least)[number]
        return out

    def wand(self, terms: list[int], slack: float) -> list[tuple[int, float]]:
        """(item, score) of a passage's items with a score of ``slack`` or more, by block-max WAND."""
        post, keys, weight, top = memoryview(self.post), memoryview(self.keys), self.weight, self.top
        # A list: its item, its place, its end, its largest weight, its term.
        lists = [[post[a], a, z, h, t] for a, z, h, t in zip(self.begin[terms].tolist(), self.begin[np.add(terms, 1)].tolist(), self.highest[terms].tolist(), terms)]
        low, out = slack - 1e-9, []

        def block_top(t: int, block: int) -> float:
            key = t * self.blocks + block
            r = bisect_left(keys, key, self.row[t], self.row[t + 1])
            return top[r] if r < self.row[t + 1] and keys[r] == key else 0.0

        def move(some: list, item: int) -> None:
            for x in some:
                if x[0] < item:
                    x[1] = bisect_left(post, item, x[1], x[2])
                    x[0] = post[x[1]] if x[1] < x[2] else -1

        while lists:
            lists.sort()
            bound, pivot = 0.0, -1
            for k, x in enumerate(lists):
                bound += x[3]
                if bound >= low:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            ahead = lists[:pivot + 1]
            if sum(block_top(x[4], item // BLOCK) for x in ahead) < low:
                skip = (item // BLOCK + 1) * BLOCK
                move(ahead, min(skip, lists[pivot + 1][0]) if pivot + 1 < len(lists) else skip)
            elif lists[0][0] == item:
                score = math.fsum(weight[x[1]] for x in ahead)
                if score >= slack:
                    out.append((item, score))
                move(ahead, item + 1)
            else:
                move(ahead, item)
            lists = [x for x in lists if x[0] >= 0]
        return out

    def search(self, words: Words, threshold: float) -> list[tuple[int, int, float]]:
        """(text, item, score) of the passages' items at or above the threshold, the best of each text."""
        if not self.items:
            return []
        passage, term, text = self.passages(words)
        if len(passage) == 0:
            return []
        slack = threshold - 1e-9
        use = self.reachable(passage, term, slack - 1e-9)
        passage, term = passage[use], term[use]
        stops = np.append(runs(passage), len(passage))
        best: dict[tuple[int, int], float] = {}
        for a, z in zip(stops[:-1], stops[1:]):
            for k, score in self.wand(term[a:z].tolist(), slack):
                found = (int(text[passage[a]]), k)
                best[found] = max(best.get(found, 0.0), score)
        return sorted((d, k, round(s, 9)) for (d, k), s in best.items())

    def leaks(self, texts: pa.Array, threshold: float, overlap: float) -> list[tuple[int, int, float, float, float]]:
        """(text, item_id, score, question overlap, answer overlap) of the checked items."""
        found = self.search(bare_words(texts), threshold)
        out = []
        for d in sorted({d for d, _, _ in found}):
            own = bare_words(texts.slice(d, 1))
            each = own.hashes()[own.codes]
            grams: dict[int, np.ndarray] = {}

            def grams_of(size: int) -> np.ndarray:
                if size not in grams:  # a short part is one shingle of all its words
                    grams[size] = shingles(own, size, whole_short=False)[0]
                return grams[size]

            for k, score in ((k, s) for e, k, s in found if e == d):
                (_, question), (_, answer) = both = self.parts_of(k)
                share = [float(np.isin(h, grams_of(min(SHINGLE, len(part)))).mean()) if len(part) else 1.0 for h, part in both]
                for low, other, ahead in ((0, 1, -len(question)), (1, 0, len(question))):
                    h, part = both[other]
                    if share[low] < overlap <= share[other] and len(both[low][1]) <= SHORT and len(part):
                        text_grams = grams_of(min(SHINGLE, len(part)))
                        at = np.flatnonzero(np.isin(text_grams, h))
                        order = np.argsort(h, kind="stable")
                        starts = at - order[np.searchsorted(h[order], text_grams[at])] + ahead
                        share[low] = max(share[low], _beside(both[low][1], starts, each, overlap))
                if min(share) >= overlap:
                    out.append((d, self.items[k][0], score, *share))
        return out


def _words_of_items(batches):
    """Per group and word the items that hold it; per group, with a null word, items, words and most words."""
    for batch in text_slices(batches):
        words = bare_words(batch.column(2))
        group = batch.column(0).to_numpy()
        owner = words.owner()
        order = np.lexsort((words.codes, owner))
        o, c = owner[order], words.codes[order]
        first = runs(o, c)
        key, items = np.unique(group[o[first]].astype(np.int64) * max(1, len(words.values)) + c[first], return_counts=True)
        full = words.counts > 0
        groups = np.unique(group[full])
        rows = [(int(k) // len(words.values), words.values[int(k) % len(words.values)], int(n), 0, 0) for k, n in zip(key, items)]
        rows += [(int(g), None, int(own.sum()), int(words.counts[own].sum()), int(words.counts[own].max())) for g in groups for own in [full & (group == g)]]
        if rows:
            columns = list(zip(*rows))
            types = (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["g", "word", "items", "words", "longest"])


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def _indexes(items: DataFrame) -> list[str]:
    """Files of the indexes of groups of items; each group has GROUP_BYTES of text or little more."""
    rows = items.select(items["item_id"].cast("long").alias("item_id"), items["text"].cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = -(-size // GROUP_BYTES)
    if not groups:
        return []
    dealt = stage(rows.select(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)).cast("int").alias("g"), "item_id", "text"), "items")
    counted = dealt.mapInArrow(_words_of_items, "g int, word binary, items long, words long, longest long")
    counted = stage(counted.groupBy("g", "word").agg(F.sum("items").alias("items"), F.sum("words").alias("words"), F.max("longest").alias("longest")), "item-words")
    total, words, longest = counted.where("word is null").agg(F.sum("items"), F.sum("words"), F.max("longest")).first()
    if not total:
        return []
    of_all = counted.where("word is not null").groupBy("word").agg(F.sum("items").alias("df"))
    known = counted.where("word is not null").select("g", "word").join(of_all, "word").select("g", "word", "df")
    folder = f"{shared_dir(items.sparkSession)}/llm/item-index-{uuid.uuid4().hex}"

    def build(key, own: pa.Table, known: pa.Table) -> pa.Table:
        index = Index(list(zip(own.column("item_id").to_pylist(), own.column("text").to_pylist())), (known.column("word").to_pylist(), known.column("df").to_pylist()), total, words / total, longest)
        fs, path = _store(folder)
        fs.create_dir(path, recursive=True)
        # A repeated attempt writes a file of its own; only names that Spark returned are read.
        name = f"{key[0].as_py()}-{uuid.uuid4().hex}"
        with fs.open_output_stream(f"{path}/{name}") as out:
            out.write(pickle.dumps(index, 5))
        return pa.table([pa.array([name])], ["name"])

    made = dealt.groupBy("g").cogroup(known.groupBy("g")).applyInArrow(build, "name string").collect()
    return [f"{folder}/{r['name']}" for r in made]


def _load(file: str) -> Index:
    fs, path = _store(file)
    with fs.open_input_stream(path) as source:
        return pickle.loads(source.read())


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.6, overlap: float = 0.75) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of every test item found in a document."""
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    rows, out = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), None
    for file in _indexes(items):
        def run(batches, file=file):
            index = _load(file)
            for batch in text_slices(batches):
                found = index.leaks(batch.column(1), threshold, overlap)
                if found:
                    columns = list(zip(*found))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0])), *[pa.array(c) for c in columns[1:]]], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        one = rows.mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.6, overlap: float = 0.75) -> DataFrame:
    """The rows of ``docs`` in which no test item is found, all columns as they are."""
    for file in _indexes(items):
        def run(batches, file=file):
            index = _load(file)
            for batch in text_slices(batches):
                bad = {d for d, *_ in index.leaks(batch.column(batch.schema.get_field_index("text")), threshold, overlap)}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)]))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
