"""Personal information in free text, found by anchor expansion and replaced by typed placeholders.

Anchors are what gives a mention away wherever it stands, in any wording: at-signs and their spelled-out forms, street
words, words for identity papers, courtesy titles and known given names, all found in one pass of an Aho-Corasick
automaton, and single letters with a full stop, plus signs, brackets and leading digits, found by a scan for characters.
From each anchor a deterministic parser expands to the left or right as far as its grammar goes, checks the form it must
have, and gives exact boundaries. Identity numbers count behind a word for them in their sentence, or anywhere if they
have check digits that are right. Overlaps go to the earlier and longer find, by a sweep over disjoint finds.

Defined cases: null and empty texts hold nothing; very long texts and mentions are used whole; repeated rows count
once; a text is otherwise left as it stands; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewright.llm.common import spread

TITLE = r"(?:(?:Mr|Ms|Mrs|Miss|Dr|Prof|Herrn|Herr|Frau|Mme|Mlle|M|Sra|Sr|don|doña|Don|Doña|Señora|Señor|Monsieur|Madame)\b\.?[  ]+)"
WORD = r"[^\W\d_]+(?:['’\-][^\W\d_]+)*"
INITIAL = r"[^\W\d_]\."
#: Words for identity papers and for what they are kept in, as whole words.
ID_WORDS = (
    "id", "identity", "identification", "passport", "ssn", "social security", "national insurance", "tax", "tax number", "employee", "personnel", "badge", "on file", "ausweis", "personalausweis", "reisepass", "steuer-id", "steuer-identifikationsnummer",
    "sozialversicherungsnummer", "dni", "nie", "nif", "pasaporte", "seguridad social", "dossier", "sécurité sociale", "carte d'identité", "passeport",
)
#: The end of a sentence; a full stop after an initial or a title is none.
SENTENCE = regex.compile(r"(?<=[\p{L}\p{N})\]]{3})(?<!\b(?:Sra|Prof|Mrs|Mme|Mlle|Herr))[.!?](?=\s)|[\p{L}\p{N}]{4}[.!?](?=\s)|\n\s*\n")
#: Function words that tell the languages of a sentence apart, of which only one has M. for a title.
FRENCH = frozenset("le les des du au aux une est et dans pour par avec qui ce cette sur ne pas vous nous il elle sa son ses".split())
OTHERS = frozenset("the and of to was is for with under at on by it that der die das und den dem ist hat von mit unter nicht el los al del y para con por se su lo que".split())
INITIALS = regex.compile(r"(?<![\p{L}\p{N}_.'’\-@])\p{L}\.")
NUMBERS = regex.compile(r"(?<![\p{L}\p{N}.,:/_\-+])[(+0-9]")
STREET_WORDS = (
    " street", " avenue", " lane", " way", " rd", " road", " crescent", " close", " drive", " court", " terrace", "straße", "strasse", "str.", "weg ", "platz ", "allee ", "gasse ", "ring ", "ufer ", "damm ", " mühle ", " chemin ", " rue ", " avenue ", " boulevard ", " place ", " quai ", " impasse ", " allée ",
    ",chemin ", "calle ", "c/ ", "plaza ", "avda. ", "avenida ", "paseo ", "camino ", "an der ", "am ", "im ", "zum ", "auf der ",
)

DOT = r"(?:\.|[ ]?(?:\(dot\)|\[dot\]|\{dot\})[ ]?)"
DOMAIN = regex.compile(rf"[\p{{L}}\p{{N}}](?:[\p{{L}}\p{{N}}\-]*[\p{{L}}\p{{N}}])?(?:{DOT}[\p{{L}}\p{{N}}](?:[\p{{L}}\p{{N}}\-]*[\p{{L}}\p{{N}}])?)*{DOT}[\p{{L}}]{{2,}}", regex.I)

PHONE = regex.compile(
    r"""(?<![\p{L}\p{N}.,:/_\-+])(?:
      (?:\(?\+1\)?[ .\-]?|1[ .\-])?\(\d{3}\)[ ]?\d{3}[\-. ]\d{4}(?:[ ]?(?:ext\.?|x)[ ]?\d{1,5})?
    | (?:\+1[ .\-]?|1[.\-])?\d{3}([\-. ])\d{3}\1\d{4}(?:[ ]?(?:ext\.?|x)[ ]?\d{1,5})?
    | \+1[ ]?\d{10} | 1[2-9]\d{9}
    | (?:\(?(?:\+|00)\d{1,3}\)?)(?:[ ]?\(0\)[ ]?|[ .\-/]{1,3}|(?=\d))\d(?:[ .\-/]{0,3}\d){6,12}
    | \(0\d{1,4}\)[ ]?(?:/[ ]?)?\d(?:[ \-]?\d){5,9}
    | 0\d{1,4}[ ]/[ ]\d(?:[ \-]?\d){5,9}
    | 0\d{1,4}[/\-]\d{3,8}(?:[ \-]\d{1,5})?
    | 0[1-9](?:([ .\-])\d\d)(?:\2\d\d){3} | 0[1-9]\d{8}
    | 0\d{2,4}[ ]\d{3,4}[ ]\d{3,5} | 0\d{2,4}[ ]\d{5,9}(?:[ \-]\d{2,4})?
    | [6789]\d{2}([ \-])\d{3}(?:\3\d{3}|\3?\d{3}) | [6789]\d{2}[ ]\d{2}[ ]\d{2}[ ]\d{2} | [6789]00[ ]?\d{6}
    )(?![\p{L}\p{N}_]|[.,:\-/]\d)""",
    regex.X,
)
ID = regex.compile(
    r"""(?<![\p{L}\p{N}]|\d[\-./:])(?:
      [A-Z]{2}[ ]?\d\d[ ]?\d\d[ ]?\d\d[ ]?[A-D]
    | \d{3}[ \-]\d{2}[ \-]\d{4}
    | [12][ ]?\d\d[ ]?\d\d[ ]?(?:\d\d|2[AB])[ ]?\d{3}[ ]?\d{3}[ ]?\d\d
    | \d\d[ ]\d{3}[ ]\d{3}[ ]\d{3} | \d{11}
    | [XYZ]-?\d{7}-?[A-Z] | \d{2}\.?\d{3}\.?\d{3}-?[A-Z]
    | [A-Z]{1,2}\d{6,8}[A-Z]?\d?
    | \d{9}
    )(?![\p{L}\p{N}]|[\-.]\d)""",
    regex.X,
)
STREETS = [
    regex.compile(rf"(?:(?:Unit|Flat|Apt\.?|Apartment|Suite)[ ]\d+[A-Z]?,[ ])?\d{{1,4}}[A-Z]?[ ](?:\p{{Lu}}[\p{{L}}'’\-]+[ ]){{1,3}}(?:Street|St\.?|Avenue|Ave\.?|Lane|Way|Road|Rd\.?|Crescent|Close|Drive|Court|Terrace|Square|Boulevard)\b(?:,[ ](?:Flat|Suite|Apt\.?|Unit)[ ]\d+[A-Z]?)?(?:,[ ](?:Port|Saint|New|Mount)[ ]\p{{Lu}}\p{{L}}+)?"),
    regex.compile(r"(?:An[ ]der|Am|Auf[ ]der|Im|Zum|In[ ]der)[ ]\p{Lu}[\p{L}\-]+(?:[ ]\p{Lu}[\p{L}\-]+)?[ ]\d{1,4}[ ]?[a-z]?\b(?:,[ ]\d{5}[ ]\p{Lu}[\p{L}\-]+)?"),
    regex.compile(r"\p{Lu}[\p{L}\-]*(?:straße|strasse|str\.|weg|platz|allee|gasse|ring|ufer|damm|Straße)[ ]\d{1,4}[ ]?[a-z]?\b(?:,[ ]\d{5}[ ]\p{Lu}[\p{L}\-]+)?"),
    regex.compile(r"\d{1,4}(?:[ ](?:bis|ter))?,?[ ](?:rue|avenue|boulevard|chemin|place|quai|impasse|allée|route)[ ](?:(?:du|de|des|de[ ]la)[ ]|de[ ]l['’]|d['’])?\p{Lu}[\p{L}\-]+(?:,[ ]\d{5}[ ]\p{Lu}[\p{L}\-]+)?"),
    regex.compile(r"(?:Calle|C/|Plaza|Pza\.|Avda\.|Avenida|Paseo|Camino|Ronda)[ ](?:(?:del|de[ ]la|de)[ ])?\p{Lu}[\p{L}\-]+,?[ ](?:n\.?º[ ]?)?\d{1,4}[a-z]?\b(?:,[ ]\d+\.º[ ][A-Z]\b)?(?:,[ ]\d{5}[ ]\p{Lu}[\p{L}\-]+)?"),
]
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "idnum": "[ID]", "street": "[ADDRESS]", "name": "[NAME]"}


def checked(number: str) -> bool:
    """Whether an identity number of a form with check digits has the right ones: French social security numbers (the
    rest of a division by 97), Spanish identity cards and foreigners' numbers (a letter for the rest by 23)."""
    x = "".join(c for c in number if c.isalnum())
    if len(x) == 15 and x[-2:].isdigit():
        body = x[:13].replace("2A", "19").replace("2B", "18")
        return body.isdigit() and 97 - int(body) % 97 == int(x[13:])
    if len(x) == 9 and x[-1].isalpha() and (x[0] in "XYZ" or x[0].isdigit()) and x[1:8].isdigit():
        return "TRWAGMYFPDXBNJZSQVHLCKE"[int(str("XYZ".find(x[0]) if x[0] in "XYZ" else x[0]) + x[1:8]) % 23] == x[8]
    return False


class Taken:
    """Disjoint stretches of a text, in order."""

    def __init__(self):
        self.begins: list[int] = []
        self.ends: list[int] = []

    def add(self, begin: int, end: int) -> bool:
        """Take a stretch, unless part of it is taken."""
        k = bisect.bisect_left(self.begins, end)
        if k and self.ends[k - 1] > begin:
            return False
        self.begins.insert(k, begin)
        self.ends.insert(k, end)
        return True


class Finder:
    """Finds (begin, end, kind) in a text. given: known given names, lower-cased."""

    def __init__(self, given: set[str]):
        import ahocorasick

        self.given = given
        self.auto = ahocorasick.Automaton()
        words: dict[str, set[str]] = {}
        titles = ("mr", "ms", "mrs", "miss", "dr", "prof", "herrn", "herr", "frau", "mme", "mlle", "m.", "sra", "sr", "don", "doña", "señora", "señor", "monsieur", "madame")
        for kind, cues in (("at", ("@", "(at)", "[at]", "{at}")), ("title", titles), ("id", ID_WORDS), ("street", STREET_WORDS), ("given", tuple(given))):
            for c in cues:
                words.setdefault(c, set()).add(kind)
        for w, kinds in words.items():
            self.auto.add_word(w, (len(w), kinds))
        self.auto.make_automaton()
        g = f"(?:{WORD})"
        self.titled = regex.compile(rf"(?P<title>{TITLE})(?:(?P<i>{INITIAL}[  ]?(?:{INITIAL}[  ]?)?(?P<is>{g}))|(?P<cs>{g}),[  ](?P<cg>{g})(?:[  ]{INITIAL})?|(?P<fg>{g})(?:[  ]{INITIAL})?[  ](?P<fs>{g})|(?P<os>{g}))")
        self.initialed = regex.compile(rf"{INITIAL}[  ]?(?:{INITIAL}[  ]?)?({g})")
        self.named = regex.compile(rf"({g})(?:[  ]{INITIAL})?[  ]({g})")
        self.reversed = regex.compile(rf"({g})(?:[  ]{INITIAL})?(?![\p{{L}}\p{{N}}])")

    def known(self, w: str | None) -> bool:
        return w is not None and (w.lower() in self.given or w.lower().split("-")[0] in self.given)

    @staticmethod
    def proper(w: str | None) -> bool:
        return w is not None and len(w) > 1 and w[0].isupper()

    def in_french(self, text: str, begin: int, end: int, stops: list[int]) -> bool:
        k = bisect.bisect_right(stops, begin)
        said = [w.lower() for w in re.findall(r"[^\W\d_]+", text[stops[k - 1] if k else 0 : begin] + " " + text[end : stops[bisect.bisect_left(stops, end)] if stops and stops[-1] >= end else len(text)])]
        return sum(w in FRENCH for w in said) > sum(w in OTHERS for w in said)

    def titled_at(self, text: str, at: int, stops: list[int]) -> tuple[int, int] | None:
        """The person behind a title that begins here. M. is a title in French and an initial elsewhere."""
        m = self.titled.match(text, at)
        if not m:
            return None
        start = "title" if m["title"].startswith("M.") and not self.in_french(text, m.start(), m.end(), stops) else ""
        if m["i"] and self.proper(m["is"]):
            return m.start(start or "i"), m.end("is")
        if m["cs"] and self.known(m["cg"]):
            return m.start(start or "cs"), m.end()
        if m["fg"] and self.known(m["fg"]):
            return m.start(start or "fg"), m.end("fs")
        for g in ("os", "fg", "cs"):  # a surname, whatever word follows
            if self.proper(m[g]):
                return m.start(start or g), m.end(g)
        return None

    def given_at(self, text: str, at: int) -> tuple[int, int] | None:
        """The person whose known given name begins here: with a surname behind it, or before it and a comma."""
        m = self.named.match(text, at)
        if m and self.known(m[1]) and (self.proper(m[2]) or not text[at].isupper()):
            return m.span()
        m = self.reversed.match(text, at)
        if not m or not self.known(m[1]) or at < 3 or text[at - 1] not in "  " or text[at - 2] != ",":
            return None
        begin = at - 2
        while begin > 0 and (text[begin - 1].isalpha() or (text[begin - 1] in "'’-" and begin > 1 and text[begin - 2].isalpha())):
            begin -= 1
        return (begin, m.end()) if begin < at - 2 and text[begin].isupper() == text[at].isupper() else None

    def address_at(self, text: str, begin: int, end: int) -> tuple[int, int] | None:
        """The e-mail address around an at-sign, expanded letter by letter."""
        plain = text[begin] == "@"
        right = end + (not plain and text[end : end + 1] == " ")
        left = begin
        while not plain and left > 0 and text[left - 1] == " ":
            left -= 1
        user = left
        while user > 0 and (text[user - 1].isalpha() or text[user - 1].isnumeric() or text[user - 1] in "._%+-"):
            user -= 1
        while user < left and not (text[user].isalpha() or text[user].isnumeric()):
            user += 1
        d = DOMAIN.match(text, right)
        return (user, d.end()) if d and user < left and text[left - 1] != "." else None

    def find(self, text: str) -> list[tuple[int, int, str]]:
        low = text.lower()
        if len(low) != len(text):  # a letter that grows when lower-cased would shift the places
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        hits: set[tuple[int, int, str]] = set()
        stops: list[int] | None = None
        streets: list[int] = []
        for last, (n, kinds) in self.auto.iter(low):
            begin, end = last - n + 1, last + 1
            if "at" in kinds:
                got = self.address_at(text, begin, end)
                if got:
                    hits.add((*got, "email"))
            if "street" in kinds:
                streets.append(begin)
            if kinds & {"title", "given", "id"}:
                whole = not low[begin - 1 : begin].isalnum() if begin else True
                if not whole or (low[end - 1].isalpha() and low[end : end + 1].isalnum()):
                    continue
                if stops is None:
                    stops = [m.end() for m in SENTENCE.finditer(text)]
                got = None
                if "title" in kinds and text[begin].isupper() | (low[begin:end] in ("don", "doña")):
                    got = self.titled_at(text, begin, stops)
                if not got and "given" in kinds and low[begin - 1 : begin] not in tuple("@._+-"):
                    got = self.given_at(text, begin)
                if got:
                    hits.add((*got, "name"))
                if "id" in kinds:
                    k = bisect.bisect_left(stops, end)
                    d = ID.search(text, end, stops[k] if k < len(stops) else len(text))
                    if d and any(c.isdigit() for c in d.group()):
                        hits.add((d.start(), d.end(), "idnum"))
        for m in INITIALS.finditer(text):
            p = self.initialed.match(text, m.start())
            if p and text[m.start()].isupper() and self.proper(p[1]):
                french = text.startswith("M. ", m.start()) or text.startswith("M.\u00a0", m.start())
                if not french:  # M. is a title's anchor
                    hits.add((p.start(), p.end(), "name"))
        if streets:
            for r in STREETS:
                for s in r.finditer(text):
                    k = bisect.bisect_left(streets, s.start() - 1)
                    if k < len(streets) and streets[k] <= s.end() and (s.start() == 0 or not text[s.start() - 1].isalnum()):
                        hits.add((s.start(), s.end(), "street"))
        for m in NUMBERS.finditer(text):
            p = PHONE.match(text, m.start())
            if p:
                hits.add((p.start(), p.end(), "phone"))
            d = ID.match(text, m.start())
            if d and checked(d.group()):
                hits.add((d.start(), d.end(), "idnum"))
        order = {"email": 0, "idnum": 1, "phone": 2, "street": 3, "name": 4}
        taken = Taken()
        return sorted(h for h in sorted(hits, key=lambda h: (order[h[2]], h[0], -h[1])) if taken.add(h[0], h[1]))


def placeholders(text: str, finds: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, k in finds:
        out += [text[at:a], PLACEHOLDER[k]]
        at = b
    return "".join([*out, text[at:]])


def given_names(entities: DataFrame) -> set[str]:
    """The given names of the known persons: a table of fixed size."""
    rows = entities.filter("kind = 'person' and name is not null").select(F.lower(F.split(F.trim("name"), r"\s+")[0]).alias("g")).distinct().collect()
    return {r["g"] for r in rows if len(r["g"]) > 1}


def personal_spans(df: DataFrame, id_col: str, text_col: str, given: set[str]) -> DataFrame:
    """(id, kind, begin_at, end_at): one row per mention, in code points."""

    def work(batches):
        finder = Finder(given)
        for b in batches:
            out = ([], [], [], [])
            for i, text in zip(b["id"].to_pylist(), b["text"].to_pylist()):
                for a, e, k in finder.find(text):
                    for col, v in zip(out, (i, k, a, e)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["id", "kind", "begin_at", "end_at"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null and text <> ''")
    return spread(rows).mapInArrow(work, "id long, kind string, begin_at long, end_at long").distinct()


def masked(df: DataFrame, id_col: str, text_col: str, given: set[str]) -> DataFrame:
    """(id, text, found): the texts with placeholders and the number of mentions replaced; null texts stay null."""

    def work(batches):
        finder = Finder(given)
        for b in batches:
            out, n = [], []
            for text in b["text"].to_pylist():
                finds = finder.find(text) if text else []
                out.append(placeholders(text, finds) if finds else text)
                n.append(len(finds))
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(out, pa.string()), pa.array(n, pa.int32())], ["id", "text", "found"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null").dropDuplicates(["id"])
    return rows.mapInArrow(work, "id long, text string, found int")


def rebuilt(masks: DataFrame, spans: DataFrame, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, found): masked texts (id, text, found) with the stretches of ``spans`` put back from the originals, and
    whether there are as many of them as were replaced."""
    held = spans.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("begin_at", "end_at", "kind"))).alias("spans"))
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("original")).filter("id is not null").dropDuplicates(["id"])
    parts = F.expr("transform(spans, s -> substring(original, int(s.begin_at + 1), int(s.end_at - s.begin_at)))")
    rows = masks.join(held, "id", "left").join(texts, "id").select("id", "text", "found", "spans", parts.alias("parts"))

    def work(batches):
        for b in batches:
            out, same = [], []
            for text, found, ss, said in zip(*(b[c].to_pylist() for c in ("text", "found", "spans", "parts"))):
                ss, said = ss or [], said or []
                same.append(len(ss) == found)
                at, done, got = 0, 0, []
                for s, x in zip(ss, said):  # the text between two finds is as long as it was
                    got += [text[at : at + s["begin_at"] - done], x]
                    at, done = at + s["begin_at"] - done + len(PLACEHOLDER[s["kind"]]), s["end_at"]
                out.append(None if text is None else "".join([*got, text[at:]]))
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(out, pa.string()), pa.array(same, pa.bool_())], ["id", "text", "found"])

    return rows.mapInArrow(work, "id long, text string, found boolean")
