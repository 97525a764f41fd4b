"""Variant spellings of names typed by people, linked to known entities by merging and rematching.

Each known entity starts a profile: its distinctive part (surname, or an organisation's own word) with the given
names, initials, field and legal form that its listed name shows. Distinct spellings meet profiles on shared 4-letter
grams, or on the distinctive part that stands next to a form known to go with one (blocking), are compared field by
field, and the best unambiguous match is merged. Merging unions what the spelling shows with the profile: its own
variant of the distinctive part, and its given name, initials or additions. What stands next to the distinctive part of
several entities that share a given name (or a legal form), and of hardly any others, is learned as another form of that
name (nicknames, spelled-out legal forms); no list of such forms is built in. Richer profiles enter blocking again, so
that a spelling too short or too odd on its own can match what others have shown. Rounds go on until nothing merges.

Defined cases: letters and digits are compared, lower-cased and without accents; null and blank names take no part;
a name that fits two entities equally well is linked to neither; repeated rows count once; equal spellings are
resolved once however often they occur; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewright.llm.common import join_hot, materialize, spread

TITLES = ("professor", "prof", "mister", "miss", "mrs", "mr", "ms", "dr", "sir", "doctor")
SUFFIXES = ("phd", "msc", "bsc", "mba", "md", "ops", "jr", "sr", "junior", "senior", "esq")

def fold(s: str) -> str:
    """Letters and digits, lower-cased, without accents."""
    s = s.lower().replace("ł", "l").replace("ø", "o").replace("ß", "ss").replace("æ", "ae").replace("đ", "d")
    return "".join(c for c in unicodedata.normalize("NFD", s) if c.isalnum())


def squash(s: str) -> str:
    """Letters and digits, lower-cased; accents count."""
    return "".join(c for c in s.lower() if c.isalnum())


def letters(s: str) -> int:
    """A bit for each letter or digit of a folded string; an edit changes two of them at most."""
    m = 0
    for c in s:
        m |= 1 << (ord(c) - 87 if "a" <= c <= "z" else (ord(c) - 48 if "0" <= c <= "9" else 36 + ord(c) % 24))
    return m


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between two strings; most + 1 when there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    # what both begin and end with costs nothing
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if not a or not b:
        return min(max(len(a), len(b)), most + 1)
    if most == 1:
        return 1 if len(a) == len(b) == 1 or (len(a) == 2 and a == b[::-1]) else 2
    if (letters(a) ^ letters(b)).bit_count() > 2 * most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], before[j - 2] + 1)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def short_of(word: str) -> str:
    """A pattern for abbreviations of a word: its first letter and then letters of it in order."""
    return word[0] + "".join(f"{c}?" for c in word[1:])


class Person:
    """A person's profile. more: forms learned for the given name; own: forms that merged spellings of this person showed."""

    def __init__(self, name: str, more: frozenset = frozenset(), own: frozenset = frozenset()):
        parts = [fold(p) for p in re.split(r"\s+", name.strip()) if fold(p)]
        self.core, given = parts[-1], parts[0]
        middle = parts[1:-1]
        mid = "".join(middle)
        alone = {given, *more}
        alone |= {given[:n] for n in (3, 4, 5) if len(given) > n}
        first = name.strip().lower().split()[0]
        for c, two in (("ö", "oe"), ("ü", "ue"), ("ø", "oe"), ("ä", "ae"), ("ł", "l")):
            if c in first:
                alone.add(fold(first.replace(c, two)))
        full = alone | {given + x for x in alone} | {x + given for x in more}
        self.initials = {given[0]}
        for m in {mid, "".join(x[0] for x in middle)} - {""}:
            full |= {g + m for g in full}
            self.initials.add(given[0] + m)
        self.full = full | {x for x in own if len(x) > 2}
        self.initials |= {x for x in own if len(x) <= 2}
        self.given = self.group = given
        # what may stand with the distinctive part when it holds errors
        self.wholes = [(f, letters(f + self.core)) for f in sorted(self.full)]

    def cost(self, rest: str, titled: bool) -> int | None:
        """How badly what is left of a spelling without its surname fits: 0 well, 1 with one edit or by an initial only."""
        if rest in self.full:
            return 0
        if rest in self.initials or (rest == "" and titled):
            return 1
        if len(rest) > 3 and any(edits(rest, g, 1) <= 1 for g in self.full if len(g) > 3):
            return 2
        return None

    def shown(self, rest: str) -> set[str]:
        """What a spelling may teach about the given name: what is left without the surname, and without the given name."""
        out = {rest}
        if rest.startswith(self.given):
            out.add(rest[len(self.given) :])
        if rest.endswith(self.given):
            out.add(rest[: -len(self.given)])
        return {x for x in out if len(x) > 1 and x not in self.full and x not in self.initials}


class Organisation:
    """An organisation's profile. more: forms learned for its last word, own: rests that merged spellings of it showed."""

    def __init__(self, name: str, more: frozenset = frozenset(), own: frozenset = frozenset()):
        words = [fold(p) for p in re.split(r"\s+", name.strip()) if fold(p)]
        spaced = [w for w in words if w not in ("of", "the")]
        self.group = "."
        self.plain = ""
        if "university" in words:
            self.core = next((w for w in spaced if w != "university"), words[0])
            self.rests = ["universityof", "university", "univof", "univ", "uniof", "uni", "uof", "u"]
            self.pattern = re.compile("|".join(sorted(map(re.escape, self.rests), key=len, reverse=True)))
        elif "institute" in words:
            self.core, field = words[0], words[-1]
            self.rests = [f"instituteofapplied{field}", f"{field}institute", f"instituteforapplied{field}"]
            f = short_of(field)
            self.pattern = re.compile(f"inst(itute|it)?(of|for)?(appl(ied)?)?({field}|{f})|({field}|{f})inst(itute)?")
        else:
            # the last word of a longer name is its legal form
            self.core, field, last = words[0], words[1:-1] or words[1:], words[-1] if len(words) > 2 else ""
            self.group = "." + last
            forms = sorted({last, *more} - {""})
            joined = "(and|und|u|n|plus)?".join(field) if "&" in name else "".join(field)
            heads = "(and|und|u|n|plus)?".join(field[:-1]) + ("(and|und|u|n|plus)?" if "&" in name else "") if len(field) > 1 else ""
            tail = field[-1] if field else ""
            body = f"({joined}|{heads}{short_of(tail)})" if len(tail) > 3 else f"({joined})"
            ends = [*map(re.escape, forms), *([short_of(last)] if len(last) > 3 else [])]
            self.pattern = re.compile(f"{body}({'|'.join(ends)})?" if ends else body)
            self.plain = "".join(field)
            self.rests = [self.plain + x for x in ("", *forms)]
            if "&" in name:
                self.rests += ["and".join(field) + x for x in ("", *forms)]
        self.rests += sorted(own - set(self.rests))
        self.rests = [x for x in self.rests if x]
        self.wholes = [(f, letters(f + self.core)) for f in self.rests]

    def cost(self, rest: str, titled: bool) -> int | None:
        for r in (rest, rest[3:]) if rest.startswith("the") else (rest,):
            if r in self.rests:
                return 0
            if self.pattern.fullmatch(r):
                return 1
            if len(r) > 5 and any(edits(r, x, 1) <= 1 for x in self.rests):
                return 2
        return None

    def shown(self, rest: str) -> set[str]:
        """What a spelling may teach about the legal form: what is left without the own word and the field."""
        r = rest[3:] if rest.startswith("the") else rest
        return {r[len(self.plain) :]} - {""} if self.plain and r.startswith(self.plain) and r not in self.rests else set()


def bodies(key: str):
    """A spelling with titles and additions taken off in every way they may be there: (body, titled)."""
    out = {(key, False)}
    for t in TITLES:
        if key.startswith(t):
            out.add((key[len(t) :], True))
        if key.endswith(t) and len(key) > len(t) + 1:
            out.add((key[: -len(t)], True))
    for body, titled in list(out):
        for x in SUFFIXES:
            if body.endswith(x) and len(body) > len(x) + 1:
                out.add((body[: -len(x)], titled))
    return out


def compare(key: str, profile, core: str, learned: bool) -> tuple[int, str, str] | None:
    """The cost of a match, the spelling's own variant of the distinctive part and what stands beside it, or None.

    learned: the core was merged from another spelling and is taken as it stands, without further edits."""
    best = None

    def offer(cost, variant, rest):
        nonlocal best
        if cost is not None and (best is None or cost < best[0]):
            best = (cost, variant, rest)

    person = isinstance(profile, Person)
    tries = bodies(key) if person else {(key, False)}
    for body, titled in tries:
        at = body.find(core)
        while at >= 0:
            rest = body[:at] + body[at + len(core) :]
            offer(profile.cost(rest, titled), core, rest)
            at = body.find(core, at + 1)
    if learned or (best and best[0] <= 1):
        return best
    most = 1 if len(core) < 6 else 2
    own = letters(core)
    for body, _ in tries:
        # more letters of the distinctive part are missing than errors may take away
        held = letters(body)
        if (own & ~held).bit_count() > 2:
            continue
        near = [f for f, whole in profile.wholes if (whole ^ held).bit_count() <= 4]
        # the distinctive part may hold typing errors: try it at either end, next to each form that may stand there
        for form in near:
            if len(form) < 3 or abs(len(body) - len(form) - len(core)) > most:
                continue
            if body.startswith(form):
                d = edits(body[len(form) :], core, most)
                offer(d + 1 if d <= most else None, body[len(form) :], form)
            if body.endswith(form):
                d = edits(body[: -len(form)], core, most)
                offer(d + 1 if d <= most else None, body[: -len(form)], form)
        if not person:
            for n in range(max(1, len(core) - most), len(core) + most + 1):
                for head, rest in ((body[:n], body[n:]), (body[-n:], body[:-n]), (body[3 : n + 3] if body.startswith("the") else "", body[n + 3 :])):
                    if head and (own ^ letters(head)).bit_count() <= 2 * most and profile.pattern.fullmatch(rest):
                        d = edits(head, core, most)
                        offer(d + 1 if d <= most else None, head, rest)
        if best is None and (not person or len(core) > 4):
            # one error in each part
            for form in near:
                if len(form) > 3:
                    for whole in (core + form, form + core):
                        d = edits(body, whole, 2)
                        offer(d + 1 if d <= 2 else None, core, form)
    return best


def teaches(key: str, profile, core: str) -> set[str]:
    """What a spelling that holds the distinctive part as it stands shows beside it that the profile does not know."""
    out: set[str] = set()
    for body, _ in bodies(key) if isinstance(profile, Person) else {(key, False)}:
        at = body.find(core)
        if at >= 0:
            out |= profile.shown(body[:at] + body[at + len(core) :])
    return out


def one_off(word: str) -> set[str]:
    """The word and what remains of it without one of its letters: two words one edit apart share at least one of these."""
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


class Parts:
    """Words, with their ``one_off`` variants, that a stretch of a spelling may be, one error in it or none."""

    def __init__(self, words: set[str], size: int):
        self.words, self.size = words, size
        self.near = {x for w in words for x in one_off(w)}
        # an error touches two neighbouring letters at most, so a long word keeps its first or its last letters
        self.heads, self.tails = {w[:size] for w in words}, {w[-size:] for w in words}
        self.longest = max(map(len, words), default=0)

    def may_be(self, s: str) -> bool:
        return len(s) < 2 * self.size + 1 or s[: self.size] in self.heads or s[-self.size :] in self.tails

    def met(self, s: str) -> set[str]:
        return one_off(s) & self.near


def split_keys(key: str, forms: Parts, cores: Parts) -> set[str]:
    """What a spelling may hold as distinctive part next to a form known to go with one, each without one letter, as far
    as it occurs in ``cores``. Forms over 3 letters may hold an error themselves."""
    out = set()
    for body, titled in bodies(key) | {(key[3:], False)} if key.startswith("the") else bodies(key):
        for n in range(0 if titled else 1, min(forms.longest + 1, len(body) - 1) + 1):
            for form, rest in ((body[:n], body[n:]), (body[len(body) - n :], body[: len(body) - n])):
                if len(rest) <= cores.longest + 1 and cores.may_be(rest) and (not form or form in forms.words or (len(form) > 3 and forms.may_be(form) and forms.met(form))):
                    out |= cores.met(rest)
    return out


def grams(c: str, size: int = 4):
    return F.expr(f"array_distinct(transform(sequence(1, greatest(1, length({c}) - {size - 1})), i -> substring({c}, i, {size})))")


def checked_broadcast(df: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """A written table, to be broadcast if it has at most so many rows; a larger one is left to the planner."""
    return F.broadcast(df) if df.count() <= most_rows else df


def lessons(seen: DataFrame, least_share: float = 0.5) -> dict[str, frozenset]:
    """What is learned for each given name or legal form, from (group, form, core, quoted): forms beside the distinctive
    parts of three entities of the group (two, where the name itself stands there too) that seldom stand elsewhere, and
    for organisations also forms beside ten of any kind. At most a few for each name of the table of entities, a table
    of fixed size."""
    per = seen.groupBy("group", "form").agg(F.count_distinct("core").alias("n"), F.count_distinct(F.when(F.col("quoted"), F.col("core"))).alias("q"))
    both = per.join(per.groupBy("form").agg(F.sum("n").alias("all"), F.count("*").alias("kinds")), "form")
    sure = both.filter(((F.col("n") >= 3) | (F.col("q") >= 2)) & (F.col("n") >= least_share * F.col("all")) | (F.col("group").startswith(".") & (F.col("all") >= 10) & (F.col("kinds") >= 3)))
    out: dict[str, set] = {}
    for r in sure.select("group", "form").collect():
        out.setdefault(r["group"], set()).add(r["form"])
    return {g: frozenset(x) for g, x in out.items()}


def link_names(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """(key, entity_id) for the distinct keys of ``mentions`` (key, folded) that denote one of ``entities`` (entity_id, name, kind)."""
    spark = mentions.sparkSession
    folding = F.pandas_udf(lambda s: s.map(lambda x: fold(x) if x is not None else None), "string")
    known = entities.filter("entity_id is not null and trim(name) <> ''").dropDuplicates(["entity_id"])

    def cores(batches):
        for b in batches:
            p = [(Person if k == "person" else Organisation)(n) for n, k in zip(b["name"].to_pylist(), b["kind"].to_pylist())]
            yield pa.RecordBatch.from_arrays([b["entity_id"], b["name"], b["kind"], pa.array([x.core for x in p], pa.string()), pa.array([x.group for x in p], pa.string())], ["entity_id", "name", "kind", "core", "group"])

    sound = known.withColumn("letters", folding("name")).filter("letters <> ''")
    base = materialize(sound.select("entity_id", "name", "kind").mapInArrow(cores, "entity_id long, name string, kind string, core string, group string"), "name-profiles")
    everyone = materialize(mentions.select("key", folding("key").alias("folded")).filter("folded <> ''"), "name-spellings")
    listed = {r["group"] for r in base.select("group").distinct().collect()}  # from the table of entities, of fixed size
    barred = listed | {g.removeprefix(".") for g in listed}
    lone = {r["core"] for r in base.groupBy("core").count().filter("count = 1").select("core").collect()}  # likewise
    learned: dict[str, frozenset] = {}
    own: dict[int, frozenset] = {}

    def make(name, kind, i):
        person = kind == "person"
        group = (Person if person else Organisation)(name).group
        return (Person if person else Organisation)(name, learned.get(group, frozenset()), own.get(i, frozenset()))

    shape = "folded string, entity_id long, cost int, variant string, rest string, group string, form string, core string, quoted boolean"

    def score(batches):
        """Matches, and with a null cost what a spelling teaches."""
        profiles: dict[int, object] = {}
        for b in batches:
            out: list[tuple] = []
            for key, i, name, kind, core, known_ in zip(*(b[c].to_pylist() for c in ("folded", "entity_id", "name", "kind", "core", "learned"))):
                p = profiles.get(i) or profiles.setdefault(i, make(name, kind, i))
                hit = compare(key, p, core, known_)
                if hit:
                    out.append((key, i, *hit, None, None, None, None))
                if not known_ and core in lone and core in key and not (hit and hit[0] == 0):
                    for form in teaches(key, p, core) - barred:
                        quoted = kind == "person" and (p.given + form in key or form + p.given in key)
                        out.append((key, i, None, None, None, p.group, form, core, quoted))
            cols = list(zip(*out)) or [()] * 9
            types = (pa.string(), pa.int64(), pa.int32(), *[pa.string()] * 5, pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types)], ["folded", "entity_id", "cost", "variant", "rest", "group", "form", "core", "quoted"])

    def forms_of(batches):
        for b in batches:
            out = set()
            for i, n, k in zip(b["entity_id"].to_pylist(), b["name"].to_pylist(), b["kind"].to_pylist()):
                p = make(n, k, i)
                out |= (p.full | p.initials) if k == "person" else set(p.rests)
            yield pa.RecordBatch.from_arrays([pa.array(sorted(out), pa.string())], ["form"])

    whole = F.expr("array_union(array(core), transform(sequence(1, length(core)), i -> concat(substring(core, 1, i - 1), substring(core, i + 1))))")
    columns = ["folded", "entity_id", "name", "kind", "core", "learned"]
    fresh = materialize(base.select("entity_id", "name", "kind", "core", F.lit(False).alias("learned")), "name-fresh")
    linked = seen = found = None
    forms_before: set[str] = set()
    while True:
        left = everyone.select("folded").distinct() if linked is None else everyone.select("folded").distinct().join(linked.select("folded"), "folded", "left_anti")
        left = materialize(left, "name-left")
        # listed parts are found by a quarter of their grams, learned ones stand in a spelling as they are: one gram finds them
        need = F.when(F.col("learned"), 1).otherwise(F.greatest(F.lit(1), F.floor(F.size(grams("core")) / 4)))
        keys = F.when(F.col("learned"), F.slice(F.array_sort(F.transform(grams("core"), lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g")))).getField("g"), 1, 1)).otherwise(grams("core"))
        index = materialize(fresh.filter("length(core) >= 4").withColumn("g", F.explode(keys)).withColumn("need", need), "name-index")
        met = left.withColumn("g", F.explode(grams("folded"))).join(checked_broadcast(index), "g").filter("not learned or instr(folded, core) > 0")
        met = met.groupBy("folded", "entity_id", "core", "learned").agg(F.count("*").alias("n"), F.first("name").alias("name"), F.first("kind").alias("kind"), F.first("need").alias("need")).filter("n >= need").select(columns)
        # forms and parts of the names of the table of entities, which is of fixed size, and what was learned about them
        forms = {r["form"] for r in base.mapInArrow(forms_of, "form string").distinct().collect()}
        new_forms = forms - forms_before
        parts = materialize(fresh.filter("not learned or length(core) < 4").withColumn("part", F.explode(whole)), "name-parts")
        if new_forms and not parts.isEmpty():
            held = spark.sparkContext.broadcast((Parts(new_forms, 2), Parts({r["core"] for r in parts.select("core").distinct().collect()}, 3)))

            def splits(batches, held=held):
                forms_, cores_ = held.value
                for b in batches:
                    out = ([], [])
                    for key in b["folded"].to_pylist():
                        for part in split_keys(key, forms_, cores_):
                            out[0].append(key)
                            out[1].append(part)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in out], ["folded", "part"])

            near = spread(left).mapInArrow(splits, "folded string, part string").join(checked_broadcast(parts), "part")
            met = met.unionByName(near.select(columns)).distinct()
        forms_before = forms
        hits = materialize(met.repartition("folded").mapInArrow(score, shape), "name-hits")
        # what fitted before fits still: a spelling that two entities share must not go to the one that grew
        new = hits.filter("cost is not null").select("folded", "entity_id", "cost", "variant", "rest")
        found = materialize(new if found is None else found.join(left, "folded", "left_semi").unionByName(new), "name-found")
        best = found.groupBy("folded", "entity_id").agg(F.min_by(F.struct("cost", "variant", "rest"), "cost").alias("b"))
        chosen = best.groupBy("folded").agg(F.min("b.cost").alias("least"), F.collect_list(F.struct("b.cost", "entity_id", "b.variant", "b.rest")).alias("all"))
        chosen = chosen.withColumn("top", F.expr("filter(all, x -> x.cost = least)")).filter("size(top) = 1").select("folded", F.col("top")[0]["entity_id"].alias("entity_id"), F.col("top")[0]["variant"].alias("variant"), F.col("top")[0]["rest"].alias("rest"))
        merged = materialize(chosen, "name-merges")
        linked = merged if linked is None else linked.unionByName(merged)
        told = hits.filter("cost is null").select("group", "form", "core", "quoted").distinct()
        seen = materialize(told if seen is None else seen.unionByName(told).distinct(), "name-lessons")
        more = lessons(seen)
        grown = {g for g, x in more.items() if x - learned.get(g, frozenset())}
        learned = {g: learned.get(g, frozenset()) | more.get(g, frozenset()) for g in {*learned, *more}}
        # a middle initial that two spellings show is the person's own: at most 26 for each known entity
        letter = F.substring("rest", -1, 1)
        shown = linked.join(base.filter("kind = 'person'").select("entity_id", "group"), "entity_id").filter((F.length("rest") == F.length("group") + 1) & F.col("rest").startswith(F.col("group")))
        shown = shown.groupBy("entity_id", "group", letter.alias("letter")).agg(F.count_distinct("folded").alias("n")).filter("n >= 2").collect()
        richer = [r["entity_id"] for r in shown if r["group"] + r["letter"] not in own.get(r["entity_id"], ())]
        for r in shown:
            own[r["entity_id"]] = own.get(r["entity_id"], frozenset()) | {r["group"] + r["letter"], r["group"][0] + r["letter"]}
        # the profiles that grew go on to the next round, with what they learned
        variants = linked.select("entity_id", F.col("variant").alias("core")).distinct().join(base.select("entity_id", "core"), ["entity_id", "core"], "left_anti")
        variants = variants.join(base.select("entity_id", "name", "kind", "group"), "entity_id").withColumn("learned", F.lit(True))
        newly = merged.select("entity_id", F.col("variant").alias("core"), F.lit(True).alias("new")).distinct()
        again = F.col("group").isin(sorted(grown)) | F.col("entity_id").isin(richer)
        every = base.withColumn("learned", F.lit(False)).filter(again).select("entity_id", "name", "kind", "core", "learned")
        fresh = materialize(every.unionByName(variants.join(newly, ["entity_id", "core"], "left").filter(F.col("new") | again).select("entity_id", "name", "kind", "core", "learned")), "name-fresh")
        if fresh.isEmpty() or (merged.isEmpty() and not grown and not richer):
            break
    return everyone.join(linked.select("folded", "entity_id"), "folded").select("key", "entity_id")


def name_mentions(df: DataFrame, id_col: str, slots: list[str]) -> DataFrame:
    """(id, slot, key): the names in the given columns; repeated rows may still be in."""
    squashing = F.regexp_replace(F.lower("e.name"), r"[^\p{L}\p{Nd}]+", "")
    rows = df.select(F.col(id_col).alias("id"), F.explode(F.array(*[F.struct(F.lit(s).alias("slot"), F.col(s).alias("name")) for s in slots])).alias("e"))
    return rows.filter("id is not null").select("id", "e.slot", squashing.alias("key")).filter("key <> ''")


def variant_links(df: DataFrame, id_col: str, slots: list[str], entities: DataFrame) -> DataFrame:
    """(id, slot, entity_id): mentions of a known entity under a spelling that is not its listed one."""
    said = name_mentions(df, id_col, slots)
    keys = materialize(said.groupBy("key").agg(F.count("*").alias("n")), "name-keys")
    total = keys.agg(F.sum("n")).first()[0] or 0
    links = link_names(keys.select("key"), entities)
    listed = entities.filter("entity_id is not null and name is not null").select("entity_id", F.regexp_replace(F.lower("name"), r"[^\p{L}\p{Nd}]+", "").alias("key")).distinct()
    variants = materialize(links.join(listed, ["entity_id", "key"], "left_anti").join(keys, "key"), "name-links")
    return join_hot(said, variants, ["key"], "n", total).select("id", "slot", "entity_id").distinct()
