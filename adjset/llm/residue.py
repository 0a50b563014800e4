"""Template residue and error-page text.

Method: labelled exemplars stand in an inverted index. Passages (cues, parts without a time line, their lines, up to three
neighbouring lines, and bracketed parts) that share a rare enough term with an exemplar are retrieved; by how much of an exemplar's TF-IDF weight lies in the
passage (containment) and how much of the passage's weight exemplars of one class explain (coverage), a passage is residue
or not. The index holds the rarest terms of an exemplar, as many as it takes for no passage with enough containment to be
missed. Speech exemplars compete: a passage that they explain is left alone. Document frequencies are counted over
all documents, whole texts, those of the marks of placeholders, status codes and request numbers like those of words.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import written
from ..operators.skew import HEAVY, salted_join
from . import exemplars
from .encode import class_runs, class_table, pieces, split, texts_of, word_starts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Part of a passage's weight that exemplars must explain, and part that a speech exemplar must explain to keep it.
COVERAGE, SPEECH_COVERAGE = 0.75, 0.8
#: The same where a word of speech stands in the window.
SPOKEN_COVERAGE = 0.92
#: The same for what stands in brackets, which is nothing but a prompt or something else; and the weight that a part of a
#: passage must share with one exemplar, since a short everyday clause beside other words may be speech.
SLOT_COVERAGE, PART = 0.9, 14.0
#: Weight that a window without a code must share with an exemplar that has one, so that no two everyday words suffice: what
#: 0.6 of containment takes where a code is in one of 10,000 documents.
CODELESS = 13.8
#: Neighbouring lines that are looked at together, besides the whole passage.
MOST_LINES = 3
#: Words that a task remembers at most.
MOST_SEEN = 1 << 20
#: Part of a speech exemplar that must lie in a window.
SPEECH_LEAST = 0.75
#: A term counts so often at most in one passage.
MOST_TF = 3
#: Marks of a placeholder, a status code and a request number, as terms of their own.
MARKS = SLOT_MARK, STATUS_MARK, ID_MARK = "\ue000", "\ue001", "\ue002"

# Characters that recognition confuses become one, so that damaged words still meet; zero-width characters go.
_FROM, _TO, _DROP = "01i|\u0131c", "olllle", "\u200b\u200c\u200d\ufeff\u00ad"
_FOLD = str.maketrans(dict(zip(_FROM, _TO)) | dict.fromkeys(_DROP))

# The body of a placeholder ends at its closing mark, at another opening one or at a blank line. What stands in << >> at
# length is quoted speech, so there a body has 60 characters at most.
_IN = r"(?!\n[^\S\n]*\n)"
_SYNTAX = re.compile(
    r"\{\{(?:(?!\{\{)IN.)+?\}\}\}?|\[\[(?:IN[^\[\]])+\]\]|\{%(?:(?!\{%)IN.)+?%\}|\{!(?:IN[^{}])+?!\}|[#$]\{(?:IN[^{}])+\}|<%(?:(?!<%)IN.)+?%>|<<[^<>\n]{1,60}>>|@@[^@\n]+@@|__[A-Za-z][\w.]*?__".replace("IN", _IN)
    + r"|%[A-Za-z][\w.]+%|%\([\w. ]+\)[sdSD]|(?<![\d%])%[sdSD]\b|\$[A-Za-z][\w.]+\$|\{[A-Za-z]+_\w+\}|\{[A-Za-z]{4,}\}|\{\d{1,2}\}", re.S)
_HINT = re.compile(r"\{\{|\[\[|\{%|\{!|#\{|\$\{|<%|<<|@@|__[A-Za-z]|%[A-Za-z(]|\$[A-Za-z]|\{[A-Za-z0-9]")
#: Pairs of characters that a placeholder starts with; a stands for any letter.
_HINTS, _LETTERS = ["{{", "[[", "{%", "{!", "#{", "${", "<%", "<<", "@@", "__", "%a", "%(", "$a", "{a", *[f"{{{i}" for i in range(10)]], "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words that UTF-8 read as a one-byte encoding leaves.
_BROKEN = re.compile("[\u00c2\u00c3\u00d0\u00d1\u00e3]")
_ID = re.compile(r"(?<![0-9A-Za-z])(?=[0-9a-fA-F]*[0-9])[0-9a-fA-F]{7,8}(?![0-9A-Za-z])")
#: A code outside times and decimal numbers; what follows or a colon before it may be punctuation.
_STATUS = re.compile(r"(?<![\d.,])(?<!\d:)[45]\d\d(?!\d|[.:,]\d)")
#: The same and not the number of a cue.
_STATUS_SAID = re.compile(_STATUS.pattern + r"(?![^\S\r\n]*(?:\r\n?|\n)[^\r\n]*-->)")
_ZERO = re.compile("[\u200b-\u200d\u00ad]")
_JOINTS = (".", ":", ",")
_DIGIT = re.compile(r"\d")
_NUMBER = re.compile(r"(?<![^\W_])\d+(?![^\W_])")
_LOST = re.compile(r"\w*(?:\ufffd|\?(?=\w))\w*")
_TAG = re.compile(r"</?[A-Za-z!][^<>\n]*>|\{[\\a-z][^{}A-Z\n]*[\\:][^{}\n]*\}")
_MACHINE = re.compile(r"(?<![^\s(\"'])(?![Hh][Tt][Tt][Pp][Ss]?/)(?:\$\w+|[\w.-]*/[\w./:-]*\w|(?:[a-z0-9]+_)+[a-z0-9]+|\w+\.(?:srt|vtt|html?|php|js|py|java|txt|xml|json|c|cpp|go|rb|x)(?::\d+)?\b)")
_TERM = re.compile(r"[^\W\d_]+|[\ue000-\ue002]")
_BRACKET = re.compile(r"[\[(<]([^\[\]()<>\n]{2,})[\])>]")
#: What in angle brackets is a tag of markup: closing tags, attributes, elements whose names are words of exemplars.
_MARKUP = re.compile(r"/|(?:title|caption|text|line)\s*/?$|.*\w\s*=\s*[\"']", re.I)
_BLANK = re.compile(r"\n[^\S\n]*\n")
_SENTENCE = re.compile(r"(?<=[.!?\u3002])\s+")
_MOJIBAKE = re.compile("[\u00c2\u00c3\u00d0\u00d1\u00e3][\u0080-\u00bf\u0152-\u2122]")


def fold(s: str) -> str:
    return s.lower().translate(_FOLD).replace("rn", "m").replace("vv", "w")


def terms(s: str) -> list[str]:
    """Terms of a passage: folded words and marks. Numbers, words with lost characters and names that only machines give
    (paths, products with versions, file names, words joined by underscores, variables) aren't terms."""
    if "/" in s or "_" in s or "." in s or "$" in s:
        s = _MACHINE.sub(" ", s)
    if "?" in s or "\ufffd" in s:
        s = _LOST.sub(" ", s)
    if _DIGIT.search(s):
        s = _NUMBER.sub(" ", _ID.sub(f" {ID_MARK} ", _STATUS.sub(f" {STATUS_MARK} ", s)))
    return _TERM.findall(fold(s))


def _weights(ts) -> Counter:
    w: dict[str, int] = {}
    for t in ts:
        w[t] = min(MOST_TF, w.get(t, 0) + 1)
    return Counter(w)


def _exemplar(phrase: str) -> Counter:
    w = _weights(terms(phrase.replace("{}", f" {SLOT_MARK} ")))
    return w if len(w) > 1 or sum(w.values()) > 1 or phrase not in exemplars.FILLER else Counter(dict.fromkeys(w, MOST_TF))


def _unbroken(text: str) -> str:
    """UTF-8 that was read as a one-byte encoding, read again as UTF-8; text of any other kind as it is."""
    if not _MOJIBAKE.search(text):
        return text
    out = bytearray()
    for ch in text:
        try:
            out += ch.encode("cp1252")
        except UnicodeEncodeError:
            out += bytes([ord(ch)]) if ord(ch) < 256 else ch.encode("utf-8")
    return out.decode("utf-8", "replace")


def passages(text: str):
    """(timed, passage) of a subtitle text: the lines after each time line, and parts without one."""
    for part in _BLANK.split(text):
        lines = part.split("\n")
        at = [i for i, line in enumerate(lines) if "-->" in line]
        if not at:
            yield False, part
            continue
        if lines[: at[0]] and len(lines[: at[0]]) > 1:
            yield False, "\n".join(lines[: at[0]])
        for i, j in zip(at, [*at[1:], len(lines)]):
            body = lines[i + 1 : j]
            if j < len(lines) and body and body[-1].strip().isdigit():
                body = body[:-1]
            yield True, "\n".join(body)


def _windows(passage: str):
    """(kind, text) of the passage and of parts of it. Kinds: whole, part (lines), sentence, slot (what stands in brackets)."""
    marked = _SYNTAX.sub(f" {SLOT_MARK} ", passage)
    plain = _TAG.sub("\n", marked)
    yield "whole", plain
    lines = [x for x in plain.split("\n") if x.strip()]
    # a message may be broken over lines
    parts = {p.strip(" -–\t\"'"): "part" for p in lines + ["\n".join(lines[i : i + k]) for k in range(2, min(MOST_LINES, len(lines) - 1) + 1) for i in range(len(lines) - k + 1)]}
    for p in (p.strip(" -–\t\"'") for line in lines for p in _SENTENCE.split(line)):
        parts.setdefault(p, "sentence")
    for p, kind in parts.items():
        if p and p != plain:
            yield kind, p
    for m in _BRACKET.finditer(_SYNTAX.sub(" ", passage)):
        if m.group()[0] != "<" or not _MARKUP.match(m.group(1)):
            yield "slot", m.group(1)


class Index:
    """Exemplars with their weights, and the terms under which each is found."""

    def __init__(self, df: dict[str, int], n: int):
        self.weight: dict[str, float] = {}
        self.idf = lambda t: math.log(1 + n / max(1, df.get(t, 0)))
        self.codeless = min(CODELESS, 1.5 * math.log(1 + n))
        self.spoken = frozenset(terms(exemplars.SPOKEN))
        self.part = min(PART, 1.5 * math.log(1 + n))
        self.items: list[tuple[str, list[tuple[str, int, float]], float]] = []
        self.help = {k: frozenset(terms(v)) for k, v in exemplars.HELP.items()}
        self.found: dict[str, list[int]] = {}
        self.least = {k: v[1] for k, v in exemplars.CLASSES.items()} | {"speech": SPEECH_LEAST}
        for name, phrases in [*[(k, v[0]) for k, v in exemplars.CLASSES.items()], ("speech", exemplars.SPEECH)]:
            for w in {tuple(sorted(_exemplar(p).items())) for p in phrases}:
                mass = sum(c * self.idf(t) for t, c in w)
                k, need = len(self.items), (1 - self.least[name]) * mass
                self.items.append((name, [(t, c, self.idf(t)) for t, c in w], mass))
                for t, c in sorted(w, key=lambda x: self.idf(x[0]), reverse=True):
                    self.found.setdefault(t, []).append(k)
                    need -= c * self.idf(t)
                    if need < 0:
                        break
        self.retrieving = {t for t, ks in self.found.items() if any(self.items[k][0] != "speech" for k in ks)}

    def verdict(self, kind: str, w: Counter, other: float) -> str | None:
        """The class that a window belongs to. other: weight of its terms that no exemplar has.

        A class explains the terms of all its exemplars that the window contains, and its helping words, however often they
        stand there. Speech that explains the window keeps it; else a placeholder's mark is one, and of the other classes
        the first that explains enough counts.
        """
        mass = sum(n * self.idf(t) for t, n in w.items()) + other
        classes: dict[str, list] = {}
        for k in {k for t in w for k in self.found.get(t, ())}:
            name, e, whole = self.items[k]
            shared = sum(min(n, w[t]) * x for t, n, x in e if t in w)
            if shared < self.least[name] * whole:
                continue
            if shared < self.codeless and any(t not in w for t, _, _ in e if t in (STATUS_MARK, ID_MARK)):
                continue
            union, best = classes.setdefault(name, [set(self.help.get(name, ())), 0.0])
            union.update(t for t, _, _ in e)
            classes[name][1] = max(best, shared)
        explained = lambda union: sum(n * self.idf(t) for t, n in w.items() if t in union) / mass
        if "speech" in classes and explained(classes["speech"][0] | {SLOT_MARK}) >= SPEECH_COVERAGE:
            return "speech"
        if kind == "slot":
            return "slot" if "slot" in classes and explained(classes["slot"][0]) >= SLOT_COVERAGE else None
        for name, (union, best) in classes.items():
            # a placeholder is a case whatever it stands in; the rest must be nearly all of the window, and messages whole lines
            if name == "placeholder":
                return name
            enough = SPOKEN_COVERAGE if any(t in self.spoken and t not in union for t in w) else COVERAGE
            if name not in ("speech", "slot") and explained(union) >= enough and (kind == "whole" or best >= self.part and (kind == "part" or name in ("filler", "latin"))):
                return name
        return None


def vocabulary() -> list[str]:
    """All terms of all exemplars, some hundreds."""
    return sorted({t for p in [*exemplars.SPEECH, *[p for v in exemplars.CLASSES.values() for p in v[0]]] for t in _exemplar(p)} | {t for v in [*exemplars.HELP.values(), exemplars.SPOKEN] for t in terms(v)})


def _words(texts: pa.Array, table: np.ndarray):
    """Distinct words of a batch of texts as they stand, and for every occurrence its word's number and its text's."""
    data, offsets = texts_of(texts)
    starts = split(data, offsets, table, word_starts)
    d = pieces(data, starts)
    return d.dictionary, d.indices.to_numpy(), np.searchsorted(offsets, starts, "right") - 1


def _chunks(b: pa.RecordBatch, size: int = 1024):
    for i in range(0, b.num_rows, size):
        yield b.slice(i, size)


#: What a word as it stands can be: one with a retrieving term, a code, a mark between numbers, with a digit at its ends.
HIT, STATUS, JOINT, STARTS, ENDS = 1, 2, 4, 8, 16


def _number_kind(w: str) -> int:
    return STATUS * bool(_STATUS.fullmatch(w)) | JOINT * (w in _JOINTS) | STARTS * w[:1].isdecimal() | ENDS * w[-1:].isdecimal()


def _lone(kinds: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Occurrences of codes of three digits that aren't parts of times or decimal numbers, which have . : , between numbers."""
    lone = kinds & STATUS > 0
    if len(at) > 2:
        joint = (kinds[1:-1] & JOINT > 0) & (at[2:] == at[:-2])
        lone[:-2] &= ~(joint & (kinds[2:] & STARTS > 0))
        lone[2:] &= ~(joint & (kinds[:-2] & ENDS > 0))
    return lone


def _hinted(texts: pa.Array, pairs: np.ndarray) -> list[int]:
    """Places of the texts with the look of a placeholder."""
    data, offsets = texts_of(texts)
    hints = np.flatnonzero(pairs[(data[:-1].astype(np.uint16) << 8) | data[1:]])
    return np.unique(np.searchsorted(offsets, hints, "right") - 1).tolist()


def _hint_pairs() -> np.ndarray:
    pairs = np.zeros(1 << 16, bool)
    for x in _HINTS:
        pairs[(ord(x[0]) << 8) | np.array([ord(y) for y in (x[1] if x[1] != "a" else _LETTERS)])] = True
    return pairs


def _count(runs):
    """Batches of texts -> (term, number of texts of the batch with it), marks included."""

    def run(batches):
        table, hints = class_table(runs), _hint_pairs()
        for b in batches:
            df: Counter = Counter()
            for c in _chunks(b, 4096):
                texts = c.column(0)
                words, codes, at = _words(texts, table)
                pairs = np.unique(at.astype(np.int64) * max(1, len(words)) + codes)
                kinds, ids = np.zeros(len(words), np.uint8), np.zeros(len(words), bool)
                for i, (raw, n) in enumerate(zip(words.to_pylist(), np.bincount(pairs % max(1, len(words)), minlength=len(words)).tolist())):
                    raw = raw.decode()
                    w = fold(raw)
                    if raw.isalpha() and w.isalpha():
                        df[w] += n
                        continue
                    kinds[i], ids[i] = _number_kind(raw), bool(_ID.fullmatch(raw))
                    for t in _TERM.findall(w):
                        df[t] += n
                df[SLOT_MARK] += sum(bool(_SYNTAX.search(texts[i].as_py())) for i in _hinted(texts, hints))
                if len(codes):
                    df[STATUS_MARK] += sum(bool(_STATUS_SAID.search(texts[i].as_py())) for i in np.unique(at[_lone(kinds[codes], at)]).tolist())
                    df[ID_MARK] += len(np.unique(at[ids[codes]]))
            yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.string()), pa.array(list(df.values()), pa.int64())], names=["term", "n"])

    return run


def document_frequencies(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """term, df: number of documents that a folded word occurs in, over whole texts. Spellings that fold to one word are
    counted apart, so a document with two of them counts twice; a word cut off by a digit counts as it stands. Marks have
    the number of documents with a placeholder, a code (times and cue numbers aside) or a request number."""
    return docs.select(F.col(text_column).cast("string").alias("text")).mapInArrow(_count(class_runs()), "term string, n long").groupBy("term").agg(F.sum("n").alias("df"))


def _retrieve(index_of, known: frozenset, runs):
    """Batches of (id, text) -> windows (id, passage, kind, terms with their counts) that the index retrieves."""

    def candidates(c: pa.RecordBatch, retrieving, table):
        """Places of the texts with a retrieving word or the look of a placeholder, and these words as they stand."""
        out: dict[int, set] = {i: set() for i in _hinted(c.column(1), pairs)}
        words, codes, at = _words(c.column(1), table)
        names = words.to_pylist()
        if len(seen) > MOST_SEEN:
            seen.clear()
        for w in names:
            if w not in seen:
                seen[w] = kind_of(w.decode(), retrieving)
        kinds = np.array([seen[w] for w in names], np.uint8)[codes] if names else np.zeros(0, np.uint8)
        if len(codes):
            ok = (kinds & HIT > 0) | _lone(kinds, at)
            for i, k in set(zip(at[ok].tolist(), codes[ok].tolist())):
                out.setdefault(i, set()).add(names[k].decode())
        return out

    def kind_of(w: str, retrieving) -> int:
        hit = not retrieving.isdisjoint(_TERM.findall(fold(w))) or bool(_BROKEN.search(w) or _ZERO.search(w) or _ID.fullmatch(w))
        return HIT * hit | _number_kind(w)

    seen: dict[bytes, int] = {}  # what is known of a word, to be looked at once only
    pairs = _hint_pairs()

    def run(batches):
        table, retrieving = class_table(runs), index_of().retrieving
        for c in (c for b in batches for c in _chunks(b)):
            out = []
            keys, texts = c.column(0), c.column(1)
            for i, words in candidates(c, retrieving, table).items():
                key, raw = keys[i].as_py(), texts[i].as_py()
                if not raw:
                    continue
                text = _unbroken(raw)
                whole = text is raw and not _ZERO.search(raw)
                if "\r" in text:
                    text = text.replace("\r\n", "\n").replace("\r", "\n")
                for k, (timed, passage) in enumerate(passages(text)):
                    if len(words) <= 8 and whole and not any(w in passage for w in words) and not _HINT.search(passage):
                        continue
                    bare = False  # the whole has no such term, and then no part of it has; slots are cut from the passage with its tags
                    for kind, window in _windows(passage):
                        if bare and kind in ("part", "sentence"):
                            continue
                        ts = terms(window)
                        if retrieving.isdisjoint(ts):
                            bare = bare or kind == "whole"
                        else:
                            w = _weights(ts)
                            # keys struck at random, again and again, count neither for nor against
                            struck = {x for x, y in zip(ts, ts[1:]) if x == y and len(x) > 3}
                            own, other = [t for t in w if t in known], [t for t in w if t not in known and t not in struck]
                            out.append((key, k, kind, own, [w[t] for t in own], other, [w[t] for t in other]))
            if out:
                cols = list(zip(*out))
                types = [keys.type, pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types)], names=["id", "passage", "kind", "terms", "n", "others", "m"])

    return run


def _judge(index_of):
    def run(batches):
        index = index_of()
        for b in batches:
            got = [index.verdict(kind, Counter(dict(zip(t, n))), other) for kind, t, n, other in zip(*[b.column(i).to_pylist() for i in range(2, 6)])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(got, pa.string())], names=["id", "passage", "kind", "label"])

    return run


def residue_passages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, passage, label: passages that are or hold residue; label is placeholder, slot, filler, latin, value, error or notice.

    Null, empty and blank texts have none. A passage that a speech exemplar explains has none either, whatever its parts
    are like. Repeated ids count as one document. No text is cut short.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    counts = written(document_frequencies(d))
    n = d.filter(F.length("text") > 0).count()
    vocab = vocabulary()
    own = spark.createDataFrame([(t,) for t in vocab], "term string")
    df = {r["term"]: r["df"] for r in counts.join(F.broadcast(own), "term").collect()}  # no more rows than the vocabulary
    cache: dict[str, Index] = {}

    def index_of() -> Index:
        if not cache:
            cache["index"] = Index(df, n)
        return cache["index"]

    kind = dict(d.dtypes)["id"]
    found = d.mapInArrow(_retrieve(index_of, frozenset(vocab), class_runs()), f"id {kind}, passage long, kind string, terms array<string>, n array<long>, others array<string>, m array<long>")
    found = found.withColumn("w", F.monotonically_increasing_id())
    others = found.select("id", "passage", "kind", "terms", "n", "w", F.explode_outer(F.arrays_zip("others", "m")).alias("o"))
    others = others.select("id", "passage", "kind", "terms", "n", "w", F.col("o.others").alias("term"), F.col("o.m").alias("m"))
    # words in very many windows are words of very many documents: these, a bounded list, are salted
    common = counts.orderBy(F.desc("df"), "term").limit(HEAVY)
    others = salted_join(others, counts, ["term"], [F.col("w")], common, how="left")
    weight = F.col("m") * F.log1p(F.lit(n) / F.greatest(F.coalesce("df", F.lit(0)), F.lit(1)))
    windows = others.groupBy("id", "passage", "kind", "terms", "n", "w").agg(F.coalesce(F.sum(weight), F.lit(0.0)).alias("other")).drop("w")
    judged = windows.mapInArrow(_judge(index_of), f"id {kind}, passage long, kind string, label string").filter("label IS NOT NULL")
    by = judged.groupBy("id", "passage").agg(F.max(F.when((F.col("kind") == "whole") & (F.col("label") == "speech"), 1)).alias("speech"), F.min(F.when(F.col("label") != "speech", F.col("label"))).alias("label"))
    return by.filter("speech IS NULL AND label IS NOT NULL").select(F.col("id").alias(id_column), "passage", "label")


def residue_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id of every document with residue, once."""
    return residue_passages(docs, id_column, text_column).select(id_column).distinct()


def without_residue(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` without the documents that hold residue."""
    return docs.join(residue_documents(docs, id_column, text_column), id_column, "left_anti")
