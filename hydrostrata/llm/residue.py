"""Template residue, filler, error pages and script notices: character n-gram likelihood ratios.

Character 4-gram models are fitted for natural prose (counts over all documents) and for each
residue class (seed wordings, then the corpus' own clear cases). A residue class' log likelihood ratio
against prose is summed over sliding windows; windows above a threshold localise the residue, and

* a document *consists of* filler, an error message or a notice when the localised part covers at
  least ``COVERAGE`` of its letters;
* a localised slot window holds an *unfilled placeholder* when the exact slot grammar matches in it.

Slots are told by their shape: for them letters are reduced to their kind (``{{aaaa_aaa}}``).
Models are count tables of ``BUCKETS`` hashed 4-grams, so their size does not depend on the data.
Every pass is one scan; whole texts are scored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 20
#: Share of a residue class' own grams against the prose background.
MIX = 0.85
#: Grams of a window and its mean log ratio from which it counts as residue.
WINDOW, RATIO = 24, 0.6
SLOT_WINDOW, SLOT_RATIO = 4, 0.5
#: Share of a document's letters in residue windows from which it consists of residue.
COVERAGE = 0.6
#: Coverage from which a document teaches the second round.
CLEAR = 0.75
#: Letters and digits from which a text can be residue at all.
LETTERS = 8
#: Characters of documents scored together.
CHUNK = 2_000_000
#: Whole-number scores to one nat.
UNIT = 4096

#: Seed wordings by class. Only their character statistics are used.
SEEDS: dict[str, list[str]] = {
    "filler": [
        "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.",
        "asdf qwerty test test blah blah text text xxxx xxxx foo bar baz",
        "Your text goes here. Your heading here. Your title here. Add your content here. Insert text here. Sample text goes here. Placeholder text.",
        "This is a dummy paragraph used to fill space. This is placeholder text used to check the layout. Dummy text for the page.",
        "Title of the page. Subtitle of the page. Write a short summary in this box. Body copy to follow. Caption 1",
        "Content coming soon. This page is under construction. Check back later. This section is being prepared.",
        "यहाँ नमूना पाठ आएगा। यह अनुच्छेद केवल जगह भरने के लिए है। यहाँ अपना पाठ लिखें। सामग्री शीघ्र आ रही है।",
        "இங்கே மாதிரி உரை வரும். இது இடத்தை நிரப்பும் மாதிரி உரை. உள்ளடக்கம் விரைவில் வரும்.",
        "Yahan apna content daalo. Yahan sample text aayega. Yahan apna text likho. Content jaldi aa raha hai.",
    ],
    "error": [
        "404 Not Found. The page you requested could not be found. Sorry! We could not find the page you wanted. It may have moved or the address is wrong.",
        "500 Internal Server Error. Oops, something went wrong on our side. Try reloading. Error code E1000. Please try again later.",
        "503 Service Unavailable. The service is down for maintenance. The site is under maintenance until 8:00. We apologise for the inconvenience. Scheduled maintenance.",
        "403 Forbidden. Access to this resource was refused. Access denied. Contact the administrator if you think this is a mistake.",
        "Your session has expired. Sign in again to continue. Please log in.",
        "Fatal error: Uncaught exception in /srv/www/index.php on line 10. Traceback (most recent call last): File \"main.py\", line 10, in render KeyError: 'x' Stack trace",
        "Query aborted. Connection timed out. Database error. {\"status\": 500, \"error\": \"timed out\", \"trace\": \"0a0a0a\"} {\"error\": \"not available\"}",
        "400 Bad Request. 401 Unauthorized. 405 Method Not Allowed. 408 Request Timeout. 410 Gone. 429 Too Many Requests. 502 Bad Gateway. The gateway timed out. 504 Gateway Timeout. nginx",
        "सर्वर में त्रुटि हुई है, बाद में प्रयास करें। यह पृष्ठ नहीं मिला। पृष्ठ उपलब्ध नहीं है। रखरखाव के कारण सेवा बंद है।",
        "சேவையகத்தில் பிழை ஏற்பட்டது, பின்னர் முயலவும். பக்கம் கிடைக்கவில்லை. பராமரிப்பு காரணமாக சேவை நிறுத்தப்பட்டுள்ளது.",
        "Server me error aa gaya, thodi der baad try karein. Page nahi mila. Site maintenance ke liye band hai.",
    ],
    "notice": [
        "Please enable JavaScript to view this page. JavaScript is disabled in your browser. You need to enable JavaScript to run this app.",
        "This app needs scripts to run. Turn on JavaScript in your browser and reload. Your browser blocks scripts or cookies. Allow cookies to continue. Please enable cookies.",
        "You are seeing this message because JavaScript is switched off. NOSCRIPT: this page needs a browser with active scripting. The map cannot be shown. Interactive charts need a browser.",
        "यह पृष्ठ देखने के लिए अपने ब्राउज़र में जावास्क्रिप्ट चालू करें। कृपया कुकीज़ सक्षम करें।",
        "இந்தப் பக்கத்தைக் காண ஜாவாஸ்கிரிப்டை இயக்கவும். குக்கீகளை அனுமதிக்கவும்.",
        "Page dekhne ke liye browser me JavaScript on karein. Cookies allow karein.",
    ],
}
#: Ways to write a slot; ``N`` stands for its name.
SLOTS = ["{{N}}", "{{ N }}", "{{ N | upper }}", "{N}", "${N}", "<<N>>", "[[N]]", "@@N@@", "__N__", "%N%", "#N#", "$N$", "%(N)s", "<?= $N ?>", "<?php echo $N; ?>", "{% if N %}", "{% N %}", "[INSERT N]", "[N here]", "(enter N)", "<N>", "[N का नाम यहाँ लिखें]", "[N பெயர் இங்கே]"]
SLOT_NAMES = ["name", "NAME", "title", "date", "DATE", "Unit Name", "unit_name", "first_name", "COMPANY_NAME", "report_year", "REPORT YEAR", "total", "TOTAL", "state", "district", "address", "city", "email", "नाम", "ज़िला", "இடம்", "மாவட்டத்தின்"]
_WORD = r"[\p{L}\p{M}][\p{L}\p{M}\p{N}_.]*"
_ID = r"[\p{L}\p{M}_][\p{L}\p{M}\p{N}_.]*"
#: The exact grammar of a slot, tried only where the model localises one.
SLOT = regex.compile(
    "|".join(
        [
            rf"\{{\{{\s*[#/^&]?{_ID}(?:\s+{_ID})*\s*(?:\|[^{{}}\n]*)?\}}\}}",
            r"\{%[^{}\n]{1,80}%\}",
            r"<\?(?:=|php)[^<>\n]{1,80}\?>",
            rf"\$\{{\s*{_ID}\s*\}}",
            rf"<<\s*{_WORD}(?:[ -]{_WORD})*\s*>>",
            rf"\[\[\s*{_WORD}(?:[ -]{_WORD})*\s*\]\]",
            rf"@@{_WORD}@@",
            r"(?<![\p{L}_])__[\p{Lu}][\p{Lu}\p{N}_]*?__(?![\p{L}_])",
            r"%(?:[\p{Lu}][\p{Lu}\p{N}_]{2,}|[\p{Ll}][\p{Ll}\p{N}_]{2,})%",
            r"(?<![\p{L}\p{N}#])#[\p{Lu}][\p{Lu}_]{3,}#",
            r"\$[\p{Lu}][\p{Lu}\p{N}_]{2,}\$",
            rf"%\({_ID}\)[sdSD]",
            r"(?<![\p{L}\p{N}$\{\\])\{[\p{L}_][\p{L}\p{M}\p{N}_]{2,}\}(?!\})",
            r"\[(?i:insert|enter|add|your|fill in)\b[^\[\]\n]{1,60}\]",
            r"\[[^\[\]\n]{1,60}\b(?i:here)\]",
            r"\((?i:enter|insert|fill in|type)\s[^()\n]{1,40}\)",
            r"\[[^\[\]\n]{0,60}(?:लिखें|भरें|இங்கே|எழுதவும்|likhein|likho|daalo|yahan)\]",
            r"\[(?:यहाँ|यहां)[^\[\]\n]{1,60}\]",
            r"<\p{Lu}[\p{L}]+(?: \p{Lu}[\p{L}]+)*>(?![^<]{0,200}</)",
            r"<[\p{Lo}\p{M}]+(?: [\p{Lo}\p{M}]+)*>",
        ]
    )
)


@cache
def _kinds() -> np.ndarray:
    """The kind of every character of the basic plane: a, A, o (other letters and marks), 0, blank, or itself."""
    kinds = np.arange(1 << 16, dtype=np.uint32)
    for i in range(1 << 16):
        k = unicodedata.category(chr(i))
        kinds[i] = 97 if k == "Ll" else 65 if k in ("Lu", "Lt") else 111 if k[0] in "LM" else 48 if k[0] == "N" else 32 if k[0] == "Z" or i in (9, 10, 13) else i
    return kinds


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of texts put end to end, and each text's length."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.array([len(t) for t in texts], np.int64)


def _shapes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the 4-gram of kinds ending at every character, and the texts' lengths."""
    c, lengths = _points(texts)
    return _hashed(np.where(c < 1 << 16, _kinds()[np.minimum(c, (1 << 16) - 1)], 111).astype(np.uint32), lengths), lengths


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the 4-gram ending at every character, the texts' lengths, and which characters are no blank."""
    c, lengths = _points([t.lower() for t in texts])
    solid = ~np.isin(c, (9, 10, 11, 12, 13, 32, 160))
    return _hashed(np.where((c >= 48) & (c <= 57), 48, np.where(solid, c, 32)).astype(np.uint32), lengths), lengths, solid


def _hashed(c: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Buckets of 4-grams. Blanks stand before the beginning of each text, so none sees its neighbour."""
    starts = np.cumsum(lengths) - lengths
    h = c * np.uint32(0x9E3779B1)
    for k, odd in ((1, 0x85EBCA77), (2, 0xC2B2AE3D), (3, 0x27D4EB2F)):
        before = np.full(len(c), 32, np.uint32)
        before[k:] = c[:-k]
        for j in range(k):
            before[starts[starts + j < len(c)] + j] = 32
        h += before * np.uint32(odd)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return ((h >> np.uint32(12)) & np.uint32(BUCKETS - 1)).astype(np.int32)


def _sums(flags: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many of each text's characters are flagged."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[str]]]:
    ids: list[int] = []
    texts: list[str] = []
    held = 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if t:
                ids.append(i)
                texts.append(t)
                held += len(t)
            if held >= CHUNK:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _windows(score: np.ndarray, lengths: np.ndarray, width: int, least: float) -> np.ndarray:
    """Characters inside a window of ``width`` grams whose mean score is at least ``least``.

    A window lies in one text; a text shorter than ``width`` is one window. Scores are whole numbers
    (``UNIT`` to one), so the sums do not depend on where in the chunk a text stands.
    """
    n = len(score)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    total = np.concatenate(([0], np.cumsum(score, dtype=np.int64)))
    hot = np.zeros(n, bool)
    if n >= width:
        hot[: n - width + 1] = total[width:] - total[:-width] >= least * width * UNIT
    over = np.zeros(n + 1, np.int32)  # places whose window would run over the end of its text
    over[np.maximum(starts, ends - width + 1)] += 1
    over[ends] -= 1
    at = np.flatnonzero(hot & (np.cumsum(over[:-1]) == 0))
    short = (lengths < width) & (total[ends] - total[starts] >= least * lengths * UNIT)
    edge = np.zeros(n + 1, np.int32)
    edge[at] += 1
    edge[at + width] -= 1
    edge[starts[short]] += 1
    edge[ends[short]] -= 1
    return np.cumsum(edge[:-1]) > 0


class Models:
    """Log likelihood ratio of every bucket, per residue class, against prose."""

    def __init__(self, prose: np.ndarray, classes: dict[str, np.ndarray]):
        self.tables = {}
        for name, counts in classes.items():
            base = prose[BUCKETS:] if name == "slot" else prose[:BUCKETS]
            background = (base + 0.5) / (base.sum() + 0.5 * BUCKETS)
            own = counts / max(1.0, counts.sum())
            ratio = np.log(MIX * own / background + (1 - MIX)).clip(-2.0, 6.0)
            self.tables[name] = np.round(ratio * UNIT).astype(np.int32)

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
        """Covered share of each text, its letters and digits, and the slots that stand in its slot windows."""
        gram, lengths, solid = _grams(texts)
        covered = np.zeros(len(gram), bool)
        for name in ("filler", "error", "notice"):
            covered |= _windows(self.tables[name][gram], lengths, WINDOW, RATIO)
        share = _sums(covered & solid, lengths) / np.maximum(1, _sums(solid, lengths))
        points, lengths = _points(texts)
        shape, _ = _shapes(texts)
        letters = _sums(np.isin(_kinds()[np.minimum(points, (1 << 16) - 1)], (97, 65, 111, 48)), lengths)
        slots: list[list[str]] = [[] for _ in texts]
        hot = np.flatnonzero(_windows(self.tables["slot"][shape], lengths, SLOT_WINDOW, SLOT_RATIO))
        if len(hot):
            ends = np.cumsum(lengths)
            of = np.searchsorted(ends, hot, "right")
            cut = np.flatnonzero((np.diff(hot) > 1) | (np.diff(of) > 0)) + 1
            for part in np.split(np.arange(len(hot)), cut):
                k = int(of[part[0]])
                start = int(ends[k] - lengths[k])
                a, b = max(0, int(hot[part[0]]) - start - 64), int(hot[part[-1]]) - start + 65
                slots[k] += SLOT.findall(texts[k][a:b])
        return share, letters, slots


def _counts(scorer: Callable[[list[str]], np.ndarray] | None):
    """Gram counts of a partition, of all texts or of those that ``scorer`` picks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * BUCKETS, np.int64)
        for _, texts in _chunks(batches):
            if scorer is not None:
                texts = [t for t, ok in zip(texts, scorer(texts), strict=True) if ok]
                if not texts:
                    continue
            total[:BUCKETS] += np.bincount(_grams(texts)[0], minlength=BUCKETS)
            total[BUCKETS:] += np.bincount(_shapes(texts)[0], minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["bucket", "n"])

    return run


def _collected(df: DataFrame) -> np.ndarray:
    """The table of at most ``2 * BUCKETS`` counts: of grams, then of shapes."""
    table = df.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 * BUCKETS)
    out[table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return out


def seed_counts() -> dict[str, np.ndarray]:
    slots = [" " + s.replace("N", n) + " " for s in SLOTS for n in SLOT_NAMES]
    counts = {k: np.bincount(_grams(v)[0], minlength=BUCKETS).astype(float) for k, v in SEEDS.items()}
    return counts | {"slot": np.bincount(_shapes(slots)[0], minlength=BUCKETS).astype(float)}


def fit(documents: DataFrame, rounds: int = 1) -> Models:
    """Models from all documents: prose counts, seeds, then ``rounds`` of the clear cases found with them."""
    slim = documents.select("doc_id", "text").where("text is not null")
    prose = _collected(slim.mapInArrow(_counts(None), "bucket int, n long"))
    seeds = seed_counts()
    models = Models(prose, seeds)
    for _ in range(rounds):
        shipped = documents.sparkSession.sparkContext.broadcast(models)
        clear = _collected(slim.mapInArrow(_counts(lambda t, s=shipped: s.value.score(t)[0] >= CLEAR), "bucket int, n long"))
        weight = max(1.0, clear[:BUCKETS].sum() / max(1.0, sum(v.sum() for k, v in seeds.items() if k != "slot")))
        learned = sum(v for k, v in seeds.items() if k != "slot") * weight + clear[:BUCKETS]
        models = Models(prose, {k: (v if k == "slot" else learned) for k, v in seeds.items()})
    return models


def residue(documents: DataFrame, models: Models | None = None) -> DataFrame:
    """(doc_id, coverage, n_slots, kind) of every document with a text; kind is ``slot``, ``residue`` or ``prose``.

    Null and empty texts have no row; blank and one-sign texts are prose. Repeated rows give repeated rows.
    """
    shipped = documents.sparkSession.sparkContext.broadcast(models or fit(documents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _chunks(batches):
            share, letters, slots = shipped.value.score(texts)
            n = [len(s) for s in slots]
            kind = ["slot" if k else "residue" if s >= COVERAGE and m >= LETTERS else "prose" for k, s, m in zip(n, share, letters, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(share, pa.float64()), pa.array(n, pa.int32()), pa.array(kind)], names=["doc_id", "coverage", "n_slots", "kind"])

    return documents.select("doc_id", "text").where("text is not null").mapInArrow(run, "doc_id long, coverage double, n_slots int, kind string")


def clean_documents(documents: DataFrame, found: DataFrame) -> DataFrame:
    """``documents`` without those of kind slot or residue."""
    return documents.join(found.where("kind <> 'prose'").select("doc_id").distinct(), "doc_id", "left_anti")
