"""Personal information inside free text (problem 8): offset-preserving deobfuscation.

Each line that may hold something is rewritten by transducers into a plain form, every sign of which knows the signs of
the line it came from. Detectors read the plain form; what they find is mapped back and taken from the line as it stands.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: signs that look like Latin ones
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухԁԛԝһӏ", "ABESIJKMHOPCTYXaesijopcyxdqwhl"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονικα", "ABEZHIKMNOPTYXovika"))
HOMOGLYPHS = CYRILLIC | GREEK
#: signs that show nothing
HIDDEN = frozenset("\u00ad\u200b\u200c\u2060\ufeff")
#: signs read as another one wherever they stand
ALIKE = {"\u00a0": " ", "\u202f": " ", "\u2007": " ", "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2212": "-", "’": "'", "ʼ": "'", "﹫": "@", "․": "."} | {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}

# fixed values: words for digits
DIGIT_WORDS = {w: str(d) for d, words in enumerate(("zero oh null nul cero zéro", "one eins un uno", "two zwei zwo deux dos", "three drei trois tres", "four vier quatre cuatro", "five fünf cinq cinco", "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve")) for w in words.split()}
REPEATS = {"double": 2, "triple": 3}
_WORD = "|".join(sorted([*DIGIT_WORDS, *(f"{r} (?:{'|'.join(DIGIT_WORDS)})" for r in REPEATS)], key=len, reverse=True))
SPELLED = rf"(?i:\b(?:(?:plus|{_WORD})[ -]){{5,}}(?:{_WORD})\b)"

LABEL = "[A-Za-z0-9-]+"
OPEN, SHUT = r"[\[({<]", r"[\])}>]"
AT = rf"(?:%40|&#64;|&#[xX]40;|&commat;| ?{OPEN}(?i:at){SHUT} ?)"
DOT = rf"(?:%2[eE]|&#46;|&period;| ?{OPEN}(?i:dot|\.){SHUT} ?)"
SPOKEN = rf"(?<=[A-Za-z0-9]) (?i:at) (?=(?:{LABEL}(?: (?i:dot) |\.))*{LABEL} (?i:dot) [A-Za-z]{{2}})"
SPOKEN_DOT = rf"(?<=[A-Za-z0-9]) (?i:dot) (?=[A-Za-z0-9])"
REWRITES = re.compile(rf"(?P<at>{AT}|{SPOKEN})|(?P<dot>{DOT}|{SPOKEN_DOT})|(?P<digits>{SPELLED})")

# Upper case first letter and word, composed or with combining marks.
U, W = "[A-ZÀ-ÖØ-ÞŁŚŻŠŽČ]", "[A-ZÀ-ÖØ-ÞŁŚŻŠŽČ](?:[A-Za-zÀ-ÖØ-öø-ſ\u0300-\u036f]|['’][A-Za-zÀ-ÖØ-öø-ſ])+"

EMAIL = rf"(?<![A-Za-z0-9._+-])[A-Za-z0-9._+-]*[A-Za-z0-9._+-]@(?:{LABEL}\.)+[A-Za-z]{{2,}}"

S = "[ .-]"
G = "[ ./-]"
PHONE = rf"(?:\+\d(?:{G}?(?:\(0\) ?)?\d){{8,13}}|00[1-9]\d(?:{S}\d{{2,6}}){{2,5}}|\(\d{{3}}\) ?\d{{3}}{S}\d{{4}}|[2-9]\d\d(?:-\d{{3}}-|\.\d{{3}}\.| \d{{3}} )\d{{4}}|0\d{{4}} \d{{6}}|0\d\d \d{{4}} \d{{4}}|0\d{{3}} \d{{3}} \d{{3}}|0\d\d \d{{5}} \d{{3}}|0\d{{1,4}}/\d{{5,9}}|0\d(?:[. ]\d\d){{4}})"

# fixed values: what numbers of persons are called
LABELS = r"(?i:ssn|soc(?:ial|\.) sec(?:urity|\.)(?: (?:number|no\.?))?|social insurance (?:number|no\.?)|nino|ni (?:number|no\.?)|national insurance (?:number|no\.?)|passport(?: (?:number|no\.?))?|passeport|pasaporte|pass-nr\.?|reisepass(?:-?nr\.?)?|dni|nif|nie|pesel|documento|tin|tax (?:id|number|no\.?)|steuer-?(?:id|nr\.?)|personal(?:-?nr\.?|nummer| number| no\.?)|personnel (?:number|no\.?)|employee (?:id|number|no\.?)|national id(?:entity)?(?: (?:number|no\.?))?|ausweis(?:-?nr\.?)?)"
ID = r"(?:[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]|[A-Z]{1,2}\d{7,8}|[A-Z]\d{4} \d{4}|\d{3}[- ]\d\d[- ]\d{4}|\d\d \d{3} \d{3} \d{3}|\d{8}-\d{4}|\d{8}-?[A-Z]|\d{6}-\d{4}|\d{11}|\d{9})"
ID_AFTER = rf"{LABELS}[\"'\\]{{0,2}}(?: ?[:=|#] ?| : | )(?:[\"'\\]{{0,2}})({ID})"
ID_BEFORE = rf"({ID})[\"'\\]{{0,2}}\)? {{1,2}}(?:#|\(|//) ?{LABELS}"

# fixed values: how streets are called
N = "[0-9]+[a-z]?(?:[–-][0-9]+[a-z]?)?"
STREET = (
    rf"{N} (?:(?:Old|New|West|East|North|South|Upper|Lower|[NSEW]\.) )?{W} (?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Crescent|Hill|Court|Ct|Way|Close|Place|Terrace|Square|Boulevard|Blvd)",
    rf"{N}(?: bis| ter)?,? (?:rue|avenue|boulevard|place|chemin|quai|impasse|av\.|bd) (?:de la |des |du |de |d['’])?{W}",
    rf"{U}[A-Za-zÀ-ÖØ-öø-ſ]+(?:straße|strasse|str\.|weg|platz|gasse|allee|ring|damm|ufer|gatan|gata|vägen|gade|vej|straat|laan) {N}",
    rf"(?:{W} (?:Str\.|Straße|Weg|Platz)|(?:Am|Im|Zum|Zur|An der|An den|Auf der) {W}) {N}",
    rf"(?:Calle|C/|Avda\.|Avenida|Plaza|Paseo|Camino) (?:de la |de los |del |de )?{W},? (?:n\.º )?{N}",
    rf"(?:ul\.|al\.|pl\.) {W} {N}",
)

# fixed values: particles, titles and the words that names stand beside
PARTICLE = "(?:van der|van den|van|von|zu|de la|de los|del|de|della|di|da|dos|du|la|le|bin|ibn|al|el|ter|ten)"
FAMILY = rf"(?:{PARTICLE} )?{W}(?:-{W})?"
INITIALS = r"(?: [A-Z]\.)*"
NAME = rf"(?:(?:{W}(?:-{W})?|[A-Z]\.){INITIALS} {FAMILY}|{FAMILY}, (?:{W}(?:-{W})?|[A-Z]\.){INITIALS})"
TITLE = r"(?:(?:Dr|Prof|Mr|Mrs|Ms|M|Mme|Herr|Frau|Sra?)\.? )*"
NAMED = (
    rf"(?:__author__ = \\?[\"']|[Ww]ritten by |Notebook by |operator=|owner = \\?[\"']|TODO\(|Thanks to |Author: |Review(?:er)?: |Signed-off-by: |[Aa]pproved by |Betreut von |Préparé par |<td>){TITLE}({NAME})",
    rf"(?:^|[\n\"])\d+ {{3}}({NAME}) {{3}}",
    rf"(?:\bAs |\bAsk ){TITLE}({NAME})(?= noted| before)",
    rf"({NAME})(?= recorded )",
)


class Plain:
    """A line in plain form. source(a, b): the part of the line that signs a until b of text came from."""

    __slots__ = ("text", "starts", "ends", "spoken")

    def __init__(self, line: str):
        self.starts = self.ends = None
        self.text = line
        self.spoken: list[tuple[int, int]] = []  # numbers that stood as words
        if not line.isascii():
            self._signs()
        if REWRITES.search(self.text):
            self._rewrite()

    def source(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.starts is None else (self.starts[a], self.ends[b - 1])

    def _signs(self) -> None:
        """Sign by sign: what shows nothing goes, a letter and its mark become one, what looks like a Latin sign becomes it, in words with Latin letters only."""
        line = self.text
        out, starts, ends = [], [], []
        mixed = set()
        if any(c in HOMOGLYPHS for c in line):
            for m in re.finditer(r"[\w.+@-]+", line):
                if re.search("[A-Za-z]", m[0]) and any(c in HOMOGLYPHS for c in m[0]):
                    mixed.update(range(*m.span()))
        for i, c in enumerate(line):
            if c in HIDDEN:
                continue
            if "\u0300" <= c <= "\u036f" and out and len(whole := unicodedata.normalize("NFC", out[-1] + c)) == 1:
                out[-1], ends[-1] = whole, i + 1
                continue
            out.append(ALIKE.get(c, c) if i not in mixed else HOMOGLYPHS.get(c, ALIKE.get(c, c)))
            starts.append(i)
            ends.append(i + 1)
        self.text, self.starts, self.ends = "".join(out), starts, ends

    def _rewrite(self) -> None:
        """Disguised at and dot signs, and digits written as words. All signs of what is put in come from all that it replaces."""
        out, starts, ends, last = [], [], [], 0
        one = list(range(len(self.text))) if self.starts is None else self.starts
        two = [i + 1 for i in one] if self.ends is None else self.ends

        def copy(a: int, b: int) -> None:
            out.append(self.text[a:b])
            starts.extend(one[a:b])
            ends.extend(two[a:b])

        for m in REWRITES.finditer(self.text):
            put = "@" if m["at"] else "." if m["dot"] else _digits(m[0])
            copy(last, m.start())
            if m["digits"]:
                self.spoken.append((len(starts), len(starts) + len(put)))
            out.append(put)
            starts.extend([one[m.start()]] * len(put))
            ends.extend([two[m.end() - 1]] * len(put))
            last = m.end()
        copy(last, len(self.text))
        self.text, self.starts, self.ends = "".join(out), starts, ends


def _digits(words: str) -> str:
    out, times = [], 1
    for w in re.split("[ -]", words.lower()):
        if w in REPEATS:
            times = REPEATS[w]
        elif w == "plus":
            out.append("+")
        else:
            out.append(DIGIT_WORDS[w] * times)
            times = 1
    return "".join(out)


def line_filter(given: list[str]) -> str:
    """Lines without any of these hold nothing; RE2 reads through them fast. It has no look-around and needs none here."""
    plain = [p.replace("(?=", "(?:") for p in NAMED]
    at = rf"[A-Za-z0-9._+-](?:[@＠﹫]|{AT})|[A-Za-z0-9] (?i:at) (?:{LABEL}(?: (?i:dot) |\.))*{LABEL} (?i:dot) [A-Za-z]{{2}}"
    # the plain form has one kind of space and hyphen, the line may have others
    space, hyphen = " \u00a0\u202f\u2007", "\u2010-\u2012\u2212-"
    phone = PHONE.replace(S, "\0").replace(G, "\1").replace(r"-\d{3}-", rf"[{hyphen}]\d{{3}}[{hyphen}]").replace("[. ]", "\2").replace(" ", f"[{space}]").replace("\2", f"[.{space}]").replace("\0", f"[.{space}{hyphen}]").replace("\1", f"[./{space}{hyphen}]")
    odd = f"[{''.join(HIDDEN)}]|[A-Za-z@.][{''.join(HOMOGLYPHS)}]|[{''.join(HOMOGLYPHS)}][A-Za-z@.]|[\uff01-\uff5e]|[A-Za-z][\u0300-\u036f]"
    return "|".join([at, phone, ID_AFTER, ID_BEFORE, *STREET, *plain, rf"(?:{'|'.join(map(re.escape, given)) or '[^ -~]{99}'}) (?:[A-Z]\. |[a-z]{{2,5}} ){{0,3}}{U}", SPELLED.replace(r"\b", ""), odd])


def same_name(s: str) -> str:
    return unicodedata.normalize("NFC", s).replace("’", "'").removeprefix("O'").lower()


class Finder:
    def __init__(self, given: list[str], family: list[str]):
        self.given, self.family = {same_name(x) for x in given}, {same_name(x) for x in family}
        self.email = re.compile(EMAIL)
        self.phone = re.compile(rf"(?<![\w.+/:–-])(?<!\d ){PHONE}(?![\w])(?![.-]\d)(?! \d{{2}})")
        self.ids = [re.compile(rf"(?<!\w){p}" if p is ID_AFTER else rf"(?<![\w.-]){p}") for p in (ID_AFTER, ID_BEFORE)]
        self.id_end = re.compile(r"[\w]|-\w")
        self.streets = [re.compile(rf"(?<![\w.–/-]){p}(?![\w–])") for p in STREET]
        self.named = [re.compile(p) for p in NAMED]
        self.any_name = re.compile(rf"(?<![\w'’-])(?=({NAME})(?![\w'’\u0300-\u036f]))")

    def spans(self, line: str) -> list[tuple[int, int, str]]:
        """The pieces of a line as they stand in it, in order; none lies over another."""
        # written-out line ends are no part of a word; the length stays
        plain = Plain(re.sub(r"\\[nrt]", "\n\n", line) if "\\" in line else line)
        s = plain.text
        out: list[tuple[int, int, str]] = []

        def add(a: int, b: int, kind: str) -> None:
            start, end = plain.source(a, b)
            if all(end <= x or y <= start for x, y, _ in out):
                out.append((start, end, kind))

        if "@" in s:
            for m in self.email.finditer(s):
                start = m.start()
                while s[start] in "._+-":
                    start += 1
                if s[start] != "@":
                    add(start, m.end(), "email")
        for p in self.ids:
            for m in p.finditer(s):
                if not self.id_end.match(s, m.end(1)):
                    add(*m.span(1), "identity")
        for p in self.streets:
            for m in p.finditer(s):
                add(*m.span(), "address")
        for m in self.phone.finditer(s):
            add(*m.span(), "phone")
        for a, b in plain.spoken:
            if 7 <= b - a <= 16:
                add(a, b, "phone")
        for p in self.named:
            for m in p.finditer(s):
                add(*m.span(1), "name")
        for m in self.any_name.finditer(s):
            if self.known(m[1]):
                add(*m.span(1), "name")
        return sorted(out)

    def known(self, name: str) -> bool:
        """Whether both the given name, or initial, and the family name are in the list."""
        last, comma, first = name.partition(", ")
        words = name.split(" ")
        first, last = (first.split(" ")[0], last.split(" ")[-1]) if comma else (words[0], words[-1])
        return same_name(first) in self.given and any(same_name(x) in self.family for x in last.split("-"))


def scanned(batches: Iterator, given: list[str], family: list[str], masked: bool) -> Iterator:
    """Of (doc, text) either (doc, kind, found_text) or (doc, text) with placeholders."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    finder, lines_with = Finder(given, family), line_filter(given)
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            texts = [(x or "").split("\n") for x in part.column(1).to_pylist()]
            ends = np.cumsum([len(x) for x in texts])
            flat = pa.array([line for x in texts for line in x], pa.large_string())
            hits = np.flatnonzero(pc.match_substring_regex(flat, lines_with).to_numpy(zero_copy_only=False))
            own = np.searchsorted(ends, hits, side="right")
            docs, found, seen = part.column(0).to_pylist(), [], set()
            for doc, k in zip(own.tolist(), hits.tolist()):
                i = k - int(ends[doc] - len(texts[doc]))
                line = texts[doc][i]
                spans = finder.spans(line)
                for a, b, kind in spans:
                    if (x := (docs[doc], kind, line[a:b])) not in seen:
                        seen.add(x)
                        found.append(x)
                if masked and spans:
                    for a, b, kind in reversed(spans):
                        line = f"{line[:a]}[{kind.upper()}]{line[b:]}"
                    texts[doc][i] = line
            if masked:
                null = part.column(1).is_null().to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if n else "\n".join(x) for n, x in zip(null, texts)], pa.string())], ["doc", "text"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], t) for j, t in enumerate((pa.int64(), pa.string(), pa.string()))], ["doc", "kind", "found_text"])


#: A list of names is sent to every task, so it may hold so many rows at most; more is an error, not a cut.
NAMES = 200_000


def _names(names: DataFrame) -> tuple[list[str], list[str]]:
    rows = names.where("name is not null").select("name", "kind").limit(NAMES + 1).collect()
    if len(rows) > NAMES:
        raise ValueError(f"the list of names holds more than {NAMES} rows")
    return tuple(sorted({n for n, k in rows if k == kind}) for kind in ("given", "family"))


def find(docs: DataFrame, doc: str, text: str, names: DataFrame) -> DataFrame:
    """(doc, kind, found_text): each piece of personal information of the whole text, once per document, kind and wording.

    names: (name, kind) with kind given or family. Null and empty texts hold nothing. A document longer than a batch is one row
    all the same; other columns are not read.
    """
    given, family = _names(names)
    rows = docs.where(F.length(text) > 0).select(F.col(doc).cast("bigint").alias("doc"), F.col(text).alias("text"))
    return rows.mapInArrow(lambda b: scanned(b, given, family, False), "doc bigint, kind string, found_text string").withColumnRenamed("doc", doc)


def mask(docs: DataFrame, doc: str, text: str, names: DataFrame) -> DataFrame:
    """(doc, text) of every row, each piece as [EMAIL], [PHONE], [IDENTITY], [ADDRESS] or [NAME], all else as it stands. Null stays null."""
    given, family = _names(names)
    rows = docs.select(F.col(doc).cast("bigint").alias("doc"), F.col(text).alias("text"))
    return rows.mapInArrow(lambda b: scanned(b, given, family, True), "doc bigint, text string").withColumnRenamed("doc", doc).withColumnRenamed("text", text)
