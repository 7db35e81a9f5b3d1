"""Garbled text from wrong character encoding: best-first search over encode, decode and unescape operations.

A text is taken apart at its white space. For each distinct word with characters beyond ASCII (or an HTML entity) a
search runs over the texts reachable from it: write it in one character set and read it in another, or read its
entities. A cost, which is low for plausible characters in plausible places, says which state to open next; the search
goes on until no state left can lead to a cheaper one, and the cheapest is the restored word. One more operation, the
last of its path, gives up characters that only a failed decoding leaves behind. A word is garbled if an operation leads
to a clearly cheaper one; what was given up stays in the restored word as it is, for it cannot be restored.

Plausibility needs to know words. All words of the collection are counted; those written in ASCII and seen often
enough go into a bitmap of fixed size, and words with accents count as known only if at least one in `LEXICON_SHARE`
records has them, so the list of those has a size bound too. Forms that are themselves misread words do not count.
"""

from __future__ import annotations

import heapq
import html
import unicodedata
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempolex.llm.arrow import plain, small_batches
from tempolex.session import materialise

BITMAP_BITS = 1 << 22
KNOWN_FROM = 3
LEXICON_SHARE = 2000
#: A repair must lower the cost by so much.
MARGIN = 0.55
#: What an operation adds to the cost: reading UTF-8 or entities proves itself, another single-byte reading must earn more.
PRICE = {"unescape": 0.05, **{f"{c}>utf-8": 0.05 for c in ("cp1252", "latin-1", "mac_roman", "cp437", "cp1256", "cp850", "cp1251")}}
REREAD_PRICE, GIVE_UP, GIVE_UP_PRICE = 0.3, "lost>nothing", 1.2  # the last for each place given up
#: What each character that only a failed decoding leaves behind costs beyond its place.
REMAINS_COST = 1.5
CHEAPEST = min(REREAD_PRICE, *PRICE.values())
#: Operations of one restoration at most, and results remembered by one worker.
LONGEST, MEMORY = 5, 300_000

# Marks and letters that occur in correct text.
QUOTES_OPEN, QUOTES_CLOSE = "“‘„«‹‚", "”’“»›‘"
DASHES, DOTS = "–—", "…"
SIGNS = "§€£¶±№½°²µ¼¾³¹©®™†‡•·¢¥Ø×÷‰′″"
INVISIBLE = "­​⁠﻿‌‍\xa0"
URDU = "ءآأؤئابةتثجحخدذرزسشصضطظعغفقلمنهوىيٹپچڈڑژکگںھہۂۃیےۓ۔،؛؟"
CHARSETS_FROM = ("cp1252", "latin-1", "mac_roman", "cp437", "cp1256", "cp850", "cp1251")
CHARSETS_TO = ("utf-8", "cp1252", "cp1256", "mac_roman", "cp437")
ENDINGS = ("s", "t", "d", "re", "ll", "ve", "m")

_UTF8 = regex.compile("[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}")
#: What only a failed decoding leaves behind.
_REMAINS = regex.compile(r"^Â$|�|[\x80-\x84\x86-\x9f]|(?:â€|Ã[\x80-\xbf¢‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ€]|Â[\x80-\xbf])")
_ENTITY = regex.compile(r"&(?:#\d{1,6}|#[xX][0-9a-fA-F]{1,5}|[A-Za-z]{2,8}\d{0,2});")
_LETTERS, _LETTERS_MARKS, _LETTERS_BACK = regex.compile(r"\p{L}+"), regex.compile(r"[\p{L}\p{M}]+"), regex.compile(r"(?r)[\p{L}\p{M}]+")
#: A strange capital within a word is what a wrong reading leaves of an accented letter.
_INNER_CAPITAL = regex.compile(r"\p{Ll}(?![A-Z])\p{Lu}")
_CORE = regex.compile(r"[\p{L}\p{M}]+(?:-[\p{L}\p{M}]+)*")


def _to_bytes(charset: str) -> dict[str, int]:
    """Character to byte; bytes the character set leaves open stand for the C1 control of the same number."""
    table: dict[str, int] = {}
    for b in range(128, 256):
        try:
            table[bytes([b]).decode(charset)] = b
        except UnicodeDecodeError:
            table.setdefault(chr(b), b)
    if charset in ("cp1252", "cp1256"):
        for b in range(128, 160):
            table.setdefault(chr(b), b)
    return table


def _from_bytes(charset: str) -> dict[int, str]:
    table = {}
    for b in range(128, 256):
        try:
            table[b] = bytes([b]).decode(charset)
        except UnicodeDecodeError:
            pass
    return table


ENCODE = {c: _to_bytes(c) for c in CHARSETS_FROM}
DECODE = {c: _from_bytes(c) for c in CHARSETS_TO if c != "utf-8"}


class _Bytes(dict):
    """Translation of characters to those of the bytes' numbers; what the character set lacks becomes a character that is no byte."""

    def __missing__(self, c: int) -> int:
        return self.setdefault(c, c if c < 128 else 0x100)


_BYTES = {c: _Bytes({ord(k): b for k, b in t.items()}) for c, t in ENCODE.items()}


def read_as_utf8(word: str, charset: str) -> str | None:
    """The word with every valid UTF-8 sequence among its bytes in the charset read as one; None if there is none."""
    out, done = [], 0
    for m in _UTF8.finditer(word.translate(_BYTES[charset])):
        out += word[done : m.start()], m.group().encode("latin-1").decode("utf-8")
        done = m.end()
    return "".join(out) + word[done:] if done else None


REREAD = (("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp1256"), ("cp1256", "cp1252"), ("latin-1", "cp1252"), ("cp1252", "cp437"), ("latin-1", "cp1256"), ("cp850", "cp1252"), ("cp1251", "cp1252"))
_READ = {(s, t): {ord(c): DECODE[t][b] for c, b in ENCODE[s].items() if c > "\x7f" and b in DECODE[t]} for s, t in REREAD}
_NO_CHARACTER = {(s, t): frozenset(c for c, b in ENCODE[s].items() if c > "\x7f" and b not in DECODE[t]) for s, t in REREAD}


def read_as(word: str, source: str, target: str) -> str | None:
    """The word's characters written in source and read in target; None where nothing changes or a byte has no character."""
    if not _NO_CHARACTER[source, target].isdisjoint(word):
        return None
    after = word.translate(_READ[source, target])
    return after if after != word else None


def moves(word: str) -> Iterator[tuple[str, str]]:
    """(operation, next state) from a word."""
    if "&" in word and _ENTITY.search(word):
        yield "unescape", html.unescape(word)
    if word.isascii():
        return
    for source in CHARSETS_FROM:
        w = read_as_utf8(word, source)
        if w is not None:
            yield f"{source}>utf-8", w
    for source, target in REREAD:
        w = read_as(word, source, target)
        if w is not None:
            yield f"{source}>{target}", w
    if "â" in word:  # the control characters behind it were lost
        yield "lost>mark", regex.sub(r"(?<=\p{L})â(?=s\b)", "’", regex.sub(r"^([^\p{L}]*)â(?=\p{L})", r"\1“", regex.sub(r"(?<=[\p{L}.,;])â(?=[^\p{L}]*$)", "”", word)))


def given_up(word: str) -> tuple[str, float]:
    """(the word without what only a failed decoding leaves behind, what that costs)."""
    after, places = _REMAINS.subn("", word)
    return after, GIVE_UP_PRICE * places


def bare(word: str) -> str:
    """Lower case without accents."""
    if word.isascii():
        return word.lower()
    word = word.replace("ø", "o").replace("Ø", "O").replace("œ", "oe").replace("Œ", "OE").replace("æ", "ae").replace("Æ", "AE").replace("ß", "ss").replace("ł", "l").replace("đ", "d")
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)).lower()


class Words:
    """Which words the collection knows."""

    def __init__(self, bitmap: bytes, lexicon: list[str], misread: list[str] = ()):
        """misread: forms that are not taken for the accented word they are in lower case."""
        self.bits = np.frombuffer(bitmap, np.uint8)
        self.accented, self.misread = {w.lower() for w in lexicon}, set(misread)
        self.spoken = {bare(w) for w in lexicon}

    def knows(self, word: str) -> bool:
        h = zlib.crc32(word.encode()) % BITMAP_BITS
        return bool(self.bits[h >> 3] >> (h & 7) & 1) or word in self.spoken


def _letter_cost(core: str, words: Words) -> float:
    """Cost of one run of letters."""
    if core.isascii() or core in ("Ø", "\u039cM", "\u039cm", "\u03bcm", "\u00b5m"):
        return 0.0
    strange = [c for c in core if c > "\x7f"]
    urdu = sum(c in URDU for c in strange)
    if urdu == len(core):
        return 0.1 if urdu > 1 else 1.0
    if core.lower() in words.accented and core not in words.misread and not _INNER_CAPITAL.search(core):
        return 0.2
    cost, latin = 0.0, True
    for i, c in enumerate(core):
        if c <= "\x7f":
            continue
        if "À" <= c <= "ɏ":
            if c.isupper() and i and core[i - 1].islower():
                cost += 1.5
        else:
            latin = False
            cost += 1.0 if c in URDU else 2.5
    if latin:
        known = words.knows(bare(core)) and (2 * len(strange) <= len(core) or core.islower() if len(core) > 1 else core in "àáâãäå")
        odd = sum(not ("À" <= c <= "ÿ" or c in "šžœŠŽŒŸ") for c in strange)
        if known:
            return cost + 0.3 + 0.15 * len(strange) + odd
        return cost + 1.0 + 0.35 * len(strange) + odd
    return cost + 0.5


def cost(word: str, words: Words) -> float:
    """How implausible a word's characters are where they stand; about 0 for correct text."""
    if word.isascii():
        return 3.0 * len(_ENTITY.findall(word)) if "&" in word else 0.0
    total = (3.0 * len(_ENTITY.findall(word)) if "&" in word else 0.0) + REMAINS_COST * sum(1 for _ in _REMAINS.finditer(word))
    clean = word.translate(_NO_MARKS)
    total += 0.05 * (len(word) - len(clean))
    if ("\xad" in word or "\u200d" in word or "\u200c" in word) and not all(words.knows(bare(m.group())) for m in _CORE.finditer(clean)):
        total += 0.8
    if "\xa0" in word:
        total += sum(0.15 if not t or not t.isalpha() or t[0] in URDU or words.knows(bare(t)) else 0.8 for t in (regex.sub(r"^\P{L}+|\P{L}+$", "", x) for x in word.split("\xa0")))
    cores = list(_CORE.finditer(clean))
    for m in cores:
        total += _letter_cost(m.group(), words)
    if len(cores) == 1 and cores[0].group() in URDU and len(cores[0].group()) == 1:
        total -= 0.5  # a letter of its own is not as odd as one among others
    size = len(clean)
    for i, c in enumerate(clean):
        if unicodedata.combining(c):
            total += 0.1 if "\u0610" <= c <= "\u06ed" or c in "\u0300\u0301\u0302\u0303\u0308\u030a\u030c\u0327" else 1.5
        if c <= "\x7f" or c.isalpha() or unicodedata.combining(c):
            continue
        before, after = clean[i - 1 : i] if i else "", clean[i + 1 : i + 2]
        left, right = before.isalnum(), after.isalnum()
        near_left, near_right = left or before in _CONTENT, right or after in _CONTENT
        if "\x80" <= c <= "\x9f" or c == "�":
            total += 4.0
        elif c in "’‘" and left and right:
            tail = _LETTERS.match(clean, i + 1)
            total += 0.1 if tail and bare(tail.group()) in ENDINGS else 1.6
        elif c in QUOTES_OPEN and not left and (near_right or after in QUOTES_OPEN + DASHES + "(["):
            total += 0.1
        elif c in QUOTES_CLOSE and not right and (near_left or before in QUOTES_CLOSE + DASHES + ".,;:!?)]%…"):
            total += 0.1
        elif c in DASHES:
            tail = _LETTERS_MARKS.match(clean, i + 1) if left else None
            total += 0.1 if not tail or words.knows(bare(tail.group())) else 1.2
        elif c in DOTS and not right:
            head = _LETTERS_BACK.match(clean, endpos=i)
            total += (0.1 if words.knows(bare(head.group())) else 0.8) if head else 0.1
        elif c == "\u037e" and not right:
            total += 0.1
        elif c in "§¶№€£±©®™•†‡Ø" and not left and (size == 1 or not after.isalpha() or c in "€£"):
            total += 0.1
        elif c in "½¼¾°²³µ%‰" and (before.isdigit() or before == "m" or (c == "µ" and after == "m")) and not (right and c != "µ"):
            total += 0.1
        elif unicodedata.category(c) == "Nd":
            total += 0.1
        elif c in QUOTES_OPEN + QUOTES_CLOSE + DOTS:
            total += 0.9
        elif c in SIGNS:
            total += 1.5
        elif c in "۔،؛؟":
            total += 0.1 if size == 1 or "\u0600" <= before <= "\u06ff" or "\u0600" <= after <= "\u06ff" else 1.5
        else:
            total += 2.0
    arabic = sum("؀" <= c <= "ۿ" for c in clean)
    other = sum(c > "\x7f" and not "؀" <= c <= "ۿ" and c not in QUOTES_OPEN + QUOTES_CLOSE + DASHES + DOTS for c in clean)
    return total + (1.0 if arabic and other else 0.0)


#: A quotation mark may also stand beside one of these; '' is the end of the word.
_CONTENT = tuple(SIGNS + "([#")
_NO_MARKS = {ord(c): None for c in INVISIBLE}


def search(word: str, words: Words, below: float | None = None) -> tuple[str, float, float, tuple[str, ...]]:
    """(restored word, its cost, the cost of the word itself, operations) of the cheapest state that up to LONGEST operations reach.

    Only what costs less than below, by default the word's own cost, is of interest; (word, below, own, ()) if nothing
    does. Best-first, until no state is left whose operations alone cost less than the best found: costs are never
    negative, so nothing behind the others can be cheaper. A state is opened again if it is reached for less, or in
    fewer operations. The restored word keeps what the last operation gave up.
    """
    own = cost(word, words)
    best = (own if below is None else below, word, ())
    heap, reached, costs = [(own, 0.0, word, ())], {word: [(0.0, 0)]}, {}

    def cost_of(text: str) -> float:
        if text not in costs:
            costs[text] = cost(text, words)
        return costs[text]

    while heap:
        _, spent, at, path = heapq.heappop(heap)
        if len(path) >= LONGEST or spent + CHEAPEST >= best[0]:
            continue
        after, price = given_up(at)
        if price and spent + price < best[0] and cost_of(after) + spent + price < best[0]:
            best = (cost_of(after) + spent + price, at, (*path, GIVE_UP))
        for operation, after in moves(at):
            price, n = spent + PRICE.get(operation, REREAD_PRICE), len(path) + 1
            ways = reached.setdefault(after, [])
            if price >= best[0] or any(p <= price + 1e-9 and k <= n for p, k in ways):
                continue
            ways.append((price, n))
            total, path_after = cost_of(after) + price, (*path, operation)
            if total < best[0]:
                best = (total, after, path_after)
            # states read as UTF-8 come first: that they can be read so is hardly chance
            heapq.heappush(heap, (total - 3.0 * sum(o.endswith("utf-8") for o in path_after), price, after, path_after))
    return best[1], best[0], own, best[2]


def judge(word: str, words: Words) -> tuple[bool, str]:
    """(garbled, restored word): garbled if the search finds a word cheaper by MARGIN, not by reading entities alone."""
    after, _, _, operations = search(word, words, cost(word, words) - MARGIN)
    garbled = any(o != "unescape" for o in operations)
    return garbled, after if garbled else word


_SPLIT = regex.compile(r"([ \t\r\n]+)")
_WORTH = regex.compile(r"[^\x00-\x7f]|&[#A-Za-z]")


class Judge:
    """Judges fields; made once per worker, remembers the words it has judged."""

    def __init__(self, words: Words):
        self.words, self.known = words, {}

    def word(self, w: str) -> tuple[bool, str]:
        found = self.known.get(w)
        if found is None:
            if len(self.known) >= MEMORY:
                self.known.clear()
            found = judge(w, self.words)
            self.known[w] = found
        return found

    def field(self, text: str) -> str | None:
        """The restored text of a garbled field, None for a sound one."""
        parts, bad = _SPLIT.split(text), False
        for i in range(0, len(parts), 2):
            w = parts[i]
            if not w or (w.isascii() and "&" not in w) or not _WORTH.search(w):
                continue
            garbled, after = self.word(w)
            if garbled:
                bad, parts[i] = True, after
        return "".join(parts) if bad else None


def word_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(word, form, n): whole words between white space without the ASCII marks around them, in lower case, with n each.

    Words written in ASCII have no form and are left out if seen less than KNOWN_FROM times; others have a row for every form they are written in.
    """
    text = F.concat_ws(" ", *[F.col(c) for c in columns])
    token = F.regexp_replace("t", r"^[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e“‘„«–—]+|[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e”’“»…–—]+$", "")
    tokens = df.select(F.explode(F.split(text, r"[ \t\r\n]+")).alias("t")).groupBy("t").agg(F.count("*").alias("n")).select(token.alias("form"), "n")
    words = tokens.select(F.lower("form").alias("word"), "form", "n").where(F.col("word").rlike(r"^[\p{L}-]{1,40}$"))
    forms = words.withColumn("form", F.when(~F.col("word").rlike("^[a-z-]+$"), F.col("form")))
    return forms.groupBy("word", "form").agg(F.sum("n").alias("n")).where(F.col("form").isNotNull() | (F.col("n") >= KNOWN_FROM))


def sound_words(bitmap: bytes, forms: dict[str, dict[str, int]], least: int) -> tuple[list[str], list[str]]:
    """(accented words, misread forms) of frequent words, given as the forms they are written in and how often each is seen.

    A form is misread if operations on its bytes make it a clearly cheaper word of letters, or one makes it another form
    of the list, which is more frequent. A word is accepted if its other forms are seen least times. Letters that would
    become quotation marks ('attaché', 'attach»') are no evidence here.
    """
    none = Words(bitmap, [])

    def misread(form: str) -> bool:
        if _INNER_CAPITAL.search(form):
            return True
        garbled, restored = judge(form, none)
        below = cost(form, none) - MARGIN
        cheaper = [a for o, a in moves(form) if cost(a, none) + PRICE.get(o, REREAD_PRICE) < below]
        return any(_CORE.fullmatch(a) for a in [*cheaper, *[restored] * garbled] if a != form)

    bad = {f for fs in forms.values() for f in fs if misread(f)}
    seen = {f: n for fs in forms.values() for f, n in fs.items() if f not in bad}
    bad |= {f for f, n in seen.items() if any(seen.get(after, 0) > n for _, after in moves(f))}
    accepted = [w for w, fs in forms.items() if sum(n for f, n in fs.items() if f not in bad) >= least]
    return accepted, sorted(bad)


def known_words(df: DataFrame, columns: list[str]) -> tuple[bytes, list[str], list[str]]:
    """(bitmap of the ASCII words, accented words, misread forms of frequent words) of the collection, all of bounded size."""
    rows = df.count()
    counts = materialise(word_counts(df, columns), "words")
    h = F.crc32("word") % BITMAP_BITS
    ascii_words = counts.where("form is null").select(h.cast("bigint").alias("h"))
    slices = ascii_words.groupBy(F.floor(F.col("h") / 32768).alias("b")).agg(F.bitmap_construct_agg(F.col("h") % 32768).alias("m")).collect()
    bitmap = bytearray(BITMAP_BITS // 8)
    for s in slices:  # at most BITMAP_BITS / 32768 rows of 4 KB
        bitmap[s.b * 4096 : s.b * 4096 + len(s.m)] = s.m
    least = max(KNOWN_FROM, -(-rows // LEXICON_SHARE))
    ascii_letters, letters = F.length(F.regexp_replace("word", "[^a-z]", "")), F.length("word")
    often = counts.where(F.col("form").isNotNull() & (ascii_letters * 2 >= letters))
    written = often.groupBy("word").agg(F.sum("n").alias("n"), F.collect_list(F.struct("form", "n")).alias("forms")).where(F.col("n") >= least)
    forms = {r.word: {f.form: f.n for f in r.forms} for r in written.select("word", "forms").collect()}
    return bytes(bitmap), *sound_words(bytes(bitmap), forms, least)


_judges: dict = {}


def _scan(batches: Iterator[pa.RecordBatch], shared, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    key = id(shared)
    if key not in _judges:
        _judges.clear()
        _judges[key] = Judge(Words(*shared.value))
    j = _judges[key]
    for b in batches:
        rows, after = [], []
        for i, text in enumerate(plain(b.column(2)).to_pylist()):
            fixed = j.field(text)
            if fixed is not None:
                rows.append(i)
                after.append(fixed)
        if rows:
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), b.column(2).take(at), pa.array(after, pa.string())], schema=schema)


def garbled_fields(df: DataFrame, record_id: str, columns: list[str]) -> DataFrame:
    """(record_id, field, text, restored) of every field that holds wrongly decoded characters.

    restored is the cheapest text that LONGEST operations a word reach; where characters were lost it keeps what cannot be restored.
    Null and empty fields are sound. Rows that repeat come out repeated, other columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(known_words(df, columns))
    schema = pa.schema([(record_id, pa.int64()), ("field", pa.string()), ("text", pa.string()), ("restored", pa.string())])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in columns])).alias("f")
    fields = small_batches(df).select(F.col(record_id).cast("bigint").alias(record_id), each).select(record_id, "f.field", "f.text")
    worth = fields.where(F.col("text").rlike(r"[^\x00-\x7f]|&[#A-Za-z]"))
    return worth.mapInArrow(partial(_scan, shared=shared, schema=schema), f"{record_id} bigint, field string, text string, restored string")
