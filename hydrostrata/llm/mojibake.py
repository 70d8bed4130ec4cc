"""Names garbled by a wrong decoding: code-page swaps as substitution ciphers, learnt by EM.

A wrong single-byte decoding of UTF-8 text is a substitution cipher: every byte from 0x80 on is shown as
one symbol of an unknown code page. Nothing says which page a delivery went through, so the *source* of a
name (no swap, or one of the ciphers) is a latent class. Expectation-maximisation runs over all distinct names:

* E-step: for every name and cipher the symbols are mapped to bytes, the bytes to letters, and the
  outcome is judged against character bigrams of the language; this gives the posterior of the source. A
  symbol the cipher does not know yet, next to bytes it does know, gets expected counts for every byte that
  completes a letter, in proportion to the bigrams around that letter.
* M-step: symbol-to-byte tables, the sources' shares and the bigrams are re-estimated from these counts.

Published pages give some ciphers a first guess; what names say replaces it. Names that no cipher reads and
that are no regular text (:func:`irregular`) are deciphered from nothing: a hidden chain of letters with the
language's bigrams writes their UTF-8 bytes, each byte is shown as an unknown symbol, and forward-backward
counts over all such names give the table of one more cipher (:func:`decipher`). It then takes part in EM like the others,
and the names still unread give the next, until a round explains nothing more.

Two-byte swaps (UTF-16 read in the wrong byte order or ASCII pairs read as one unit) are one more cipher. Names are
restored with ``translate`` on the learnt table, twice where text was garbled twice. Lost bytes
(U+FFFD) are filled with the letter that the bigrams prefer clearly, else the name stays unrestored.

ASCII names are only counted, in the JVM. All other names are reduced to distinct ones once; the passes
of EM scan those. Models are tables of fixed size.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrostrata.session import checkpointed, spread

#: Code pages whose published tables are the first guess of a cipher.
PAGES = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp866", "cp1251", "koi8_r", "cp1250", "cp1253", "cp1254", "iso8859_2", "iso8859_15")
UTF16 = "utf-16"
CLEAN = "clean"
BUCKETS = 1 << 18
#: EM stops when no entry of a table changes, or after so many iterations.
ITERATIONS = 6
#: Forward-backward passes of a cipher learnt from nothing, at most, and the relative gain below which they stop.
PASSES, GAIN = 20, 1e-3
#: How much less likely a capital is after a small letter (the bigrams do not tell them apart).
CAPITAL = 0.02
#: Different names that must speak for a learnt cipher, and for an entry of it.
NAMES, SPEAKERS = 8, 2
#: Stands for any character before the one that is counted.
ANY = "\0"
LOST = "�"
#: Log odds that a two-byte sign of a garbled name, not of a real one, splits into two printable ASCII signs.
WIDE_EVIDENCE = 3.0
#: Posterior from which a lost letter is filled.
FILL = 0.8
_BASE = 0xF700  # private-use place of byte 0; keeps mapped bytes apart from characters
_SEQUENCE = re.compile(f"[{chr(_BASE + 0xC2)}-{chr(_BASE + 0xDF)}][{chr(_BASE + 0x80)}-{chr(_BASE + 0xBF)}]|[{chr(_BASE + 0xE0)}-{chr(_BASE + 0xEF)}][{chr(_BASE + 0x80)}-{chr(_BASE + 0xBF)}]{{2}}")
_UNKNOWN = f"[^ -~{chr(_BASE + 0x80)}-{chr(_BASE + 0xFF)}]"
_LEAD3, _LEAD2, _TAIL = f"[{chr(_BASE + 0xE0)}-{chr(_BASE + 0xEF)}]", f"[{chr(_BASE + 0xC2)}-{chr(_BASE + 0xDF)}]", f"[{chr(_BASE + 0x80)}-{chr(_BASE + 0xBF)}]"
#: A byte sequence with one symbol that the cipher does not know, after its first byte.
_HOLE = re.compile(f"{_LEAD3}{_TAIL}{_UNKNOWN}|{_LEAD3}{_UNKNOWN}{_TAIL}|{_LEAD2}{_UNKNOWN}")
_REST = re.compile(f"[{chr(_BASE + 0xC2)}-{chr(_BASE + 0xEF)}][{chr(_BASE + 0x80)}-{chr(_BASE + 0xBF)}]")
_WIDE = re.compile("[⁀-ⁿ一-鿿㐀-䷿]{3,}")


def page_table(page: str) -> dict[str, int]:
    """symbol -> byte of a published page; bytes it leaves undefined are shown as control characters."""
    table = {}
    for b in range(0x80, 0x100):
        try:
            table[bytes([b]).decode(page)] = b
        except UnicodeDecodeError:
            table[chr(b)] = b
    return table


def _lower(text: str) -> str:
    """``text`` in lower case, character by character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _bucket(a: str, b: str) -> int:
    return (ord(a) * 40503 + ord(b) * 2654435) % BUCKETS


class Model:
    """Language bigrams, ciphers (symbol -> byte) and the sources' shares."""

    def __init__(self, bigrams: np.ndarray, ciphers: dict[str, dict[str, int]], shares: dict[str, float]):
        self.bigrams, self.ciphers, self.shares = bigrams, ciphers, shares
        self.total = max(1.0, bigrams.sum() / 2)
        self.chance = lru_cache(1 << 16)(self._chance)
        self.maps = {k: {ord(s): chr(_BASE + b) for s, b in t.items()} for k, t in ciphers.items()}
        self.best = lru_cache(1 << 16)(self._best)
        #: Symbols that can begin a byte sequence; a name without any of them is not read with the cipher.
        self.leads = {k: frozenset(s for s, b in t.items() if 0xC2 <= b <= 0xEF) for k, t in ciphers.items()}

    def __reduce__(self):
        return Model, (self.bigrams, self.ciphers, self.shares)

    def loglik(self, text: str) -> float:
        """Log likelihood of a name as a chain of character bigrams."""
        t = "^" + _lower(text) + "$"
        return sum(self.chance(a, b) for a, b in zip(t, t[1:], strict=False))

    def _chance(self, a: str, b: str) -> float:
        """Log probability that ``b`` follows ``a``, backing off to how common ``b`` is at all."""
        alone = (self.bigrams[_bucket(ANY, b)] + 0.01) / (self.total + 100.0)
        return float(np.log((self.bigrams[_bucket(a, b)] + 2 * alone) / (self.bigrams[_bucket(ANY, a)] + 2)))

    def undo(self, name: str, source: str) -> str:
        """``name`` with one layer of ``source`` undone; symbols outside valid byte sequences stay."""
        if source == UTF16:
            return _WIDE.sub(lambda m: _narrow(m.group()), name)
        mapped = name.translate(self.maps[source])
        back = {ord(v): chr(k) for k, v in self.maps[source].items()}
        return _SEQUENCE.sub(lambda m: _decoded(m.group()), mapped).translate(back)

    def leftover(self, text: str, source: str) -> bool:
        """Whether bytes of a cut letter remain in a restored name."""
        return _REST.search(text.translate(self.maps[source])) is not None

    def _best(self, name: str) -> tuple[str, str, float]:
        """(source, restored name, posterior of the source)."""
        options = [(CLEAN, name)]
        for source in (*self.ciphers, UTF16):
            if source in self.leads and self.leads[source].isdisjoint(name):
                continue
            once = self.undo(name, source)
            if once == name:
                continue
            twice = self.undo(once, source)
            options.append((source, self.undo(twice, source) if twice != once else once))
        if len(options) == 1:
            return CLEAN, name, 1.0
        scores = np.array([self.loglik(y) + np.log(self.shares.get(s, 1e-4)) + (WIDE_EVIDENCE * sum(c not in y for c in name) if s == UTF16 else 0.0) for s, y in options])
        weights = np.exp(scores - scores.max())
        k = int(scores.argmax())
        return options[k][0], options[k][1], float(weights[k] / weights.sum())

    def unread(self, name: str) -> bool:
        """Whether ``name`` is no regular text and no cipher reads it, or the one that does lacks a symbol of it."""
        if LOST in name or not irregular(name):
            return False
        source = self.best(name)[0]
        return source == CLEAN or (source != UTF16 and _HOLE.search(name.translate(self.maps[source])) is not None)

    def fill(self, name: str) -> str | None:
        """``name`` with lost letters filled, or None where no letter is clearly best."""
        letters = [chr(i) for i in (*range(0xC0, 0x250), 0x2013, 0x2014, 0x2018, 0x2019)]
        while (at := name.find(LOST)) >= 0:
            before, after = ("^" + _lower(name))[at], (_lower(name) + "$")[at + 1]
            if after == LOST:  # one lost letter may show as several signs
                width = len(name[at:]) - len(name[at:].lstrip(LOST))
                found = self._two(before, (_lower(name) + "$")[at + width], letters) if width == 2 else None
                if not found:
                    return None
                name = name[:at] + found + name[at + width :]
                continue
            p = np.exp([self.chance(before, c) + self.chance(c, after) for c in letters])
            if p.max() < FILL * p.sum() or p.max() < 1e-7:
                return None
            name = name[:at] + letters[int(p.argmax())] + name[at + 1 :]
        return name

    def _two(self, before: str, after: str, letters: list[str]) -> str | None:
        low = [c for c in letters if c == c.lower()]
        first = np.array([self.chance(before, c) for c in low])
        last = np.array([self.chance(c, after) for c in low])
        p = np.exp(first[:, None] + last[None, :] + np.array([[self.chance(a, b) for b in low] for a in low]))
        if p.max() < FILL * p.sum():
            return None
        i, j = np.unravel_index(int(p.argmax()), p.shape)
        return low[i] + low[j]


def _decoded(seq: str) -> str:
    """The letter of a byte sequence; the sequence where it is none, or no assigned one."""
    try:
        letter = bytes(ord(c) - _BASE for c in seq).decode("utf-8")
    except UnicodeDecodeError:
        return seq
    return seq if unicodedata.category(letter) in ("Cc", "Cn", "Co", "Cs") else letter


def _narrow(wide: str) -> str:
    for order in ("utf-16-le", "utf-16-be"):
        raw = wide.encode(order)
        if all(32 <= b < 127 for b in raw):
            return raw.decode("ascii").rstrip()
    return wide


_RUN = re.compile(r"[^\x00-\x7f]{2,}")


def irregular(name: str) -> bool:
    """Whether ``name`` has a run of non-ASCII signs that no writing system makes: letters of several scripts, or among other signs."""
    for run in _RUN.findall(name):
        kinds = [(unicodedata.category(c), c) for c in run if c not in "\u200c\u200d"]
        if all(k[0] == "P" for k, _ in kinds):
            continue
        if any(k[0] not in "LM" for k, _ in kinds) or len({unicodedata.name(c, "?").split()[0] for k, c in kinds if k[0] == "L"}) > 1:
            return True
    return False


def _suspect(name: str, model: Model) -> bool:
    return LOST in name or _WIDE.search(name) is not None or irregular(name) or any(_SEQUENCE.search(name.translate(m)) for k, m in model.maps.items() if not model.leads[k].isdisjoint(name))


def _initial(pages: tuple[str, ...]) -> Model:
    return Model(np.zeros(BUCKETS), {p: page_table(p) for p in pages}, {CLEAN: 0.9} | dict.fromkeys((*pages, UTF16), 0.1 / (len(pages) + 1)))


def _bigrams(texts: list[tuple[str, int]]) -> np.ndarray:
    """Counts of the bigrams of (name, times), and of every character under ``ANY``, by bucket."""
    if not texts:
        return np.zeros(BUCKETS, np.int64)
    framed = [f"^{_lower(t)}$" for t, _ in texts]
    c = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    times = np.repeat([n for _, n in texts], [len(t) for t in framed])[:-1]
    last = np.zeros(len(c), bool)
    last[np.cumsum([len(t) for t in framed]) - 1] = True
    a, b, inside = c[:-1], c[1:], ~last[:-1]
    pairs = (a * 40503 + b * 2654435) % BUCKETS
    alone = (ord(ANY) * 40503 + a * 2654435) % BUCKETS
    return (np.bincount(pairs[inside], times[inside], BUCKETS) + np.bincount(alone[inside], times[inside], BUCKETS)).astype(np.int64)


def _ascii_bigrams(names: DataFrame) -> tuple[np.ndarray, int]:
    """Bigrams of the ASCII names, counted in the JVM (pairs of 128 signs at most), and how many rows have such a name."""
    plain = names.where(~F.col("name").rlike("[^\\x00-\\x7f]")).groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("n"))
    signs = F.split(F.concat(F.lit("^"), "name", F.lit("$")), "")
    pairs = plain.select("n", signs.alias("c")).select("n", F.explode(F.transform(F.slice("c", F.lit(1), F.size("c") - 1), lambda a, i: F.struct(a.alias("a"), F.get("c", i + 1).alias("b")))).alias("p"))
    counted = pairs.groupBy("p.a", "p.b").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS)
    for a, b, n in counted:
        out[_bucket(a, b)] += n
        out[_bucket(ANY, a)] += n
    return out, sum(n for a, _, n in counted if a == "^")


def distinct_names(names: DataFrame) -> DataFrame:
    """(name, n) of the names that are not pure ASCII, written once since every pass of EM reads them."""
    counted = names.where(F.col("name").rlike("[^\\x00-\\x7f]")).groupBy("name").agg(F.count("*").alias("n"))
    return checkpointed(spread(counted, "name"))


def _counted(distinct: DataFrame, model: Model, first: bool) -> tuple[list[tuple[str, str, int, float]], np.ndarray]:
    """One pass over the distinct names: expected counts (source, symbol, byte, weight) and bigrams, as ``model`` reads them.

    A source's own weight has symbol ''. At ``first`` only the bigrams of unsuspicious names are counted.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        bigrams = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            plain: list[tuple[str, int]] = []
            for name, n in zip(batch["name"], batch["n"], strict=True):
                if first:
                    if not _suspect(name, model):
                        plain.append((name, n))
                    continue
                source, restored, p = model.best(name)
                if LOST not in restored and not irregular(restored):
                    plain.append((restored, n))
                total[source, "", 0] += p * n
                if source not in (CLEAN, UTF16):
                    _vote(total, name, source, p, model)
            bigrams += _bigrams(plain)
        used = np.flatnonzero(bigrams)
        rows = [(s, x, b, w) for (s, x, b), w in total.items()] + [("", "", int(k), float(bigrams[k])) for k in used]
        yield pd.DataFrame(rows, columns=["source", "symbol", "byte", "weight"])

    rows = distinct.mapInPandas(run, "source string, symbol string, byte int, weight double").groupBy("source", "symbol", "byte").agg(F.sum("weight").alias("weight")).toPandas()
    own = rows["source"] == ""
    bigrams = np.zeros(BUCKETS)
    bigrams[rows.loc[own, "byte"].to_numpy()] = rows.loc[own, "weight"].to_numpy()
    return list(rows.loc[~own].itertuples(index=False, name=None)), bigrams


def _vote(total: Counter, name: str, source: str, p: float, model: Model) -> None:
    """Expected counts of one garbled name: its symbols' bytes, and bytes for a symbol the cipher lacks."""
    mapped = name.translate(model.maps[source])
    for m in _SEQUENCE.finditer(mapped):
        for k in range(m.start(), m.end()):
            total[source, name[k], ord(mapped[k]) - _BASE] += p
    for m in _HOLE.finditer(mapped):
        k = next(i for i in range(m.start(), m.end()) if not _BASE <= ord(mapped[i]) < _BASE + 0x100)
        if name[k] == LOST:
            continue
        before = ("^" + _lower(name))[m.start()]
        weight = {}
        for b in range(0x80, 0xC0):
            try:
                letter = bytes(b if i == k else ord(mapped[i]) - _BASE for i in range(m.start(), m.end())).decode("utf-8")
            except UnicodeDecodeError:
                continue
            weight[b] = float(np.exp(model.chance(before, letter)))
        norm = sum(weight.values())
        for b, w in weight.items():
            if w > 0.02 * norm:
                total[source, name[k], b] += p * w / norm


class Decipherer:
    """Forward-backward over runs of unknown symbols: hidden letters with the language's bigrams, one symbol a UTF-8 byte."""

    def __init__(self, model: Model, letters: str, symbols: str, table: np.ndarray):
        self.model, self.table = model, table
        self.low = [_lower(c) for c in letters]
        self.capital = np.array([a != b for a, b in zip(letters, self.low, strict=True)])
        self.place = {c: i for i, c in enumerate(symbols)}
        self.follow = np.exp([[model._chance(a, b) for b in self.low] for a in self.low])
        self.follow[np.ix_(~self.capital & np.array([c != c.upper() for c in letters], bool), self.capital)] *= CAPITAL
        codes = [c.encode() for c in letters]
        self.bytes = {k: np.array([[c[j] - 0x80 for c in codes if len(c) == k] for j in range(k)]) for k in (2, 3)}
        self.of = {k: np.array([i for i, c in enumerate(codes) if len(c) == k], int) for k in (2, 3)}
        self.scale = float(len(symbols))  # keeps the products of long runs in range

    def shown(self, x: list[int], p: int, k: int) -> np.ndarray:
        """How well the ``k`` symbols from ``p`` show each letter of ``k`` bytes."""
        out = np.full(len(self.of[k]), self.scale**k)
        for j in range(k):
            out *= self.table[self.bytes[k][j], x[p + j]]
        return out

    def read(self, before: str, run: str, after: str, counts: np.ndarray) -> float:
        """Add the expected (byte, symbol) counts of a run; its log likelihood, or 0 where no letters can have written it."""
        x = [self.place[c] for c in run]
        n, size = len(x), len(self.low)
        steps = [k for k in (2, 3) if len(self.of[k])]
        edge = np.exp([self.model.chance(_lower(before), c) for c in self.low]), np.exp([self.model.chance(c, after) for c in self.low])
        if before.islower():
            edge[0][self.capital] *= CAPITAL
        ends, logs = np.zeros((n + 1, size)), np.zeros(n + 1)
        begins: list[np.ndarray | None] = [None] * (n + 1)
        begins[0] = edge[0]
        # a place may be reached over two or three symbols, so its sums are kept with the larger of the two scales
        for p in range(n):
            if p and not ends[p].any():
                continue
            if p:
                total = ends[p].sum()
                ends[p] /= total
                logs[p] += np.log(total)
                begins[p] = ends[p] @ self.follow
            for k in steps:
                if p + k <= n:
                    value = begins[p][self.of[k]] * self.shown(x, p, k)
                    if value.any():
                        top = max(logs[p], logs[p + k]) if ends[p + k].any() else logs[p]
                        ends[p + k] *= np.exp(logs[p + k] - top)
                        logs[p + k] = top
                        ends[p + k, self.of[k]] += value * np.exp(logs[p] - top)
        whole = float(ends[n] @ edge[1])
        if whole <= 0:
            return 0.0
        rest: list[tuple[np.ndarray, float] | None] = [None] * (n + 1)
        rest[n] = (edge[1], 0.0)
        for p in range(n - 1, -1, -1):
            if begins[p] is None:
                continue
            parts = []
            for k in steps:
                if p + k <= n and rest[p + k] is not None:
                    value, log = rest[p + k]
                    here = self.shown(x, p, k) * value[self.of[k]]
                    parts.append((k, here, log))
                    gain = begins[p][self.of[k]] * here * np.exp(logs[p] + log - logs[n]) / whole
                    for j in range(k):
                        np.add.at(counts, (self.bytes[k][j], x[p + j]), gain)
            if p and parts:
                top = max(log for _, _, log in parts)
                value = sum((self.follow[:, self.of[k]] @ here) * np.exp(log - top) for k, here, log in parts)
                total = value.sum()
                if total > 0:
                    rest[p] = (value / total, top + float(np.log(total)))
        return float(np.log(whole) + logs[n] - n * np.log(self.scale))


def _runs(name: str) -> Iterator[tuple[str, str, str]]:
    framed = "^" + name + "$"
    for m in _RUN.finditer(name):
        yield framed[m.start()], m.group(), _lower(framed[m.end() + 1])


def decipher(pool: DataFrame, model: Model, letters: str) -> dict[str, int]:
    """symbol -> byte learnt from nothing from the names of ``pool`` (one column ``name``), by forward-backward passes over all of them."""
    symbols = "".join(r[0] for r in pool.select(F.explode(F.split("name", "")).alias("c")).where(F.col("c").rlike("[^\\x00-\\x7f]")).distinct().orderBy("c").collect())
    if not symbols or not letters:
        return {}
    table, before = np.full((128, len(symbols)), 1 / len(symbols)), -np.inf
    spoken: dict[str, int] = {}
    for _ in range(PASSES):
        shipped = pool.sparkSession.sparkContext.broadcast((model, letters, symbols, table))

        def run(batches: Iterator[pd.DataFrame], shipped=shipped) -> Iterator[pd.DataFrame]:
            reader, total, speakers, log = Decipherer(*shipped.value), np.zeros(shipped.value[3].shape), Counter(), 0.0
            for batch in batches:
                for name in batch["name"]:
                    for left, part, right in _runs(name):
                        log += reader.read(left, part, right, total)
                    speakers.update({c for _, part, _ in _runs(name) for c in part})
            rows = [(shipped.value[2][j], int(i) + 0x80, float(total[i, j]), 0) for i, j in zip(*np.nonzero(total > 1e-6), strict=True)]
            yield pd.DataFrame([*rows, *((c, -1, 0.0, n) for c, n in speakers.items()), ("", -1, log, 0)], columns=["symbol", "byte", "weight", "n"])

        rows = pool.mapInPandas(run, "symbol string, byte int, weight double, n long").groupBy("symbol", "byte").agg(F.sum("weight").alias("weight"), F.sum("n").alias("n")).collect()
        counts, place = np.zeros_like(table), {c: i for i, c in enumerate(symbols)}
        for r in rows:
            if r.symbol and r.byte >= 0:
                counts[r.byte - 0x80, place[r.symbol]] = r.weight
            elif r.symbol:
                spoken[r.symbol] = r.n
        log = next(r.weight for r in rows if not r.symbol)
        table = counts + 1e-3 / len(symbols)
        table /= table.sum(axis=1, keepdims=True)
        if log - before < GAIN * abs(log):
            break
        before = log
    return {c: int(counts[:, j].argmax()) + 0x80 for c, j in place.items() if spoken.get(c, 0) >= SPEAKERS and counts[:, j].max() >= 0.5 * counts[:, j].sum() > 0}


def _unread(distinct: DataFrame, model: Model) -> DataFrame:
    """(name,) of the names that no cipher reads, or only in part."""
    shipped = distinct.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"name": [n for n in batch["name"] if shipped.value.unread(n)]}, dtype="object")

    return distinct.select("name").mapInPandas(run, "name string")


def _letters(distinct: DataFrame, model: Model) -> str:
    """The non-ASCII letters of unsuspicious names and their capitals (an alphabet: a bounded set)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = {c for n in batch["name"] if not _suspect(n, model) for c in n if not c.isascii()}
            yield pd.DataFrame({"c": sorted(seen)}, dtype="object")

    lower = {_lower(r[0]) for r in distinct.select("name").mapInPandas(run, "c string").distinct().collect()}
    return "".join(sorted(lower | {u for c in lower if len(u := c.upper()) == 1 and len(u.encode()) == len(c.encode())}))


def _refined(distinct: DataFrame, model: Model, plain: np.ndarray, rows: int, iterations: int) -> Model:
    """EM from ``model`` until its tables stand still."""
    for _ in range(iterations):
        counts, bigrams = _counted(distinct, model, first=False)
        weight = {s: w for s, x, _, w in counts if not x}
        weight[CLEAN] = weight.get(CLEAN, 0.0) + rows
        total = sum(weight.values()) or 1.0
        ciphers = {}
        for source, start in model.ciphers.items():
            votes: dict[str, Counter] = {}
            for s, x, b, w in counts:
                if s == source and x:
                    votes.setdefault(x, Counter())[b] += w
            # what the names say replaces the guess; symbols they do not show keep it
            ciphers[source] = start | {x: v.most_common(1)[0][0] for x, v in votes.items() if v.total() >= 1.0 and v.most_common(1)[0][1] >= 0.5 * v.total()}
        shares = {s: (weight.get(s, 0.0) + 0.5) / (total + 0.5 * (len(ciphers) + 2)) for s in (CLEAN, UTF16, *ciphers)}
        still = ciphers == model.ciphers
        model = Model(bigrams + plain, ciphers, shares)
        if still:
            break
    return model


def fit(names: DataFrame, iterations: int = ITERATIONS, pages: tuple[str, ...] = PAGES) -> Model:
    """The model learnt by EM from all rows of ``names`` (one string column ``name``, no nulls).

    ``pages`` are the published pages that give a cipher a first guess; with none all ciphers are learnt from nothing.
    """
    plain, rows = _ascii_bigrams(names)
    distinct = distinct_names(names)
    start = _initial(pages)
    model = Model(_counted(distinct, start, first=True)[1] + plain, start.ciphers, start.shares)
    model = _refined(distinct, model, plain, rows, iterations)
    while True:
        pool = checkpointed(_unread(distinct, model))
        unread = pool.count()
        if unread < NAMES:
            return model
        table = decipher(pool, model, _letters(distinct, start))
        name = f"learnt-{sum(c.startswith('learnt') for c in model.ciphers) + 1}"
        shares = model.shares | {name: unread / max(1, rows + unread)}
        richer = _refined(distinct, Model(model.bigrams, model.ciphers | {name: table}, shares), plain, rows, iterations)
        if unread - _unread(distinct, richer).count() < NAMES:
            return model
        model = richer


def garbled(rows: DataFrame, name: Column | str, model: Model) -> DataFrame:
    """``rows`` whose ``name`` is garbled, with ``source``, ``restored`` (null where it cannot be) and ``posterior``.

    Null, blank and pure ASCII names never come out. Correct names in any script, with accents or
    odd signs, are read as clean. Columns of ``rows`` are kept; ``_name`` is added on the way and dropped.
    """
    kept = rows.columns
    suspects = rows.withColumn("_name", F.col(name) if isinstance(name, str) else name).where(F.col("_name").rlike("[^\\x00-\\x7f]"))
    shipped = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("source string, restored string, posterior double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shipped.value
        for batch in batches:
            out = []
            for text in batch:
                source, restored, p = own.best(text)
                if source not in (CLEAN, UTF16) and (LOST in restored or own.leftover(restored, source) or irregular(restored)):
                    restored = None
                elif LOST in restored:
                    source, restored = "lost", own.fill(restored)
                out.append((source, restored, p))
            yield pd.DataFrame(out, columns=["source", "restored", "posterior"])

    judged = suspects.withColumn("_j", judge("_name")).where(F.col("_j.source") != CLEAN)
    return judged.select(*kept, "_j.source", "_j.restored", "_j.posterior")


def hierarchy_names(districts: DataFrame, units: DataFrame) -> DataFrame:
    """(table_name, record_id, name) of both tables, null names left out."""
    def side(df: DataFrame, table: str, key: str, column: str) -> DataFrame:
        return df.select(F.lit(table).alias("table_name"), F.col(key).alias("record_id"), F.col(column).alias("name")).where("name is not null")

    return side(districts, "districts", "district_id", "district_name").unionByName(side(units, "assessment_units", "unit_id", "unit_name"))


def garbled_names(districts: DataFrame, units: DataFrame, model: Model | None = None) -> DataFrame:
    """(table_name, record_id, name, source, restored, posterior) of every garbled district or unit name."""
    names = hierarchy_names(districts, units)
    return garbled(names, "name", model or fit(names.select("name")))
