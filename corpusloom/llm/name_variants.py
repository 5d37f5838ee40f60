"""P3: variant spellings of names typed by people, led to their entity by noisy-channel attribution.

A spelling s denotes the canonical form c that maximises P(c) * P(s | c). P(c) comes from how often c itself is spelled
out; candidates are the reference names and, beside them, frequent well-formed spellings of people the reference doesn't
list. P(s | c) is the likelihood of the typing slips, abbreviations, nicknames and reorderings that lead from c to s.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.runtime import materialise

# Common English short forms of given names.
NICKNAMES = """
abigail abby gail; adrian ade; alexander alex sasha sandy xander al lex; amelia amy millie mia; anthony tony ant;
benjamin ben benny benji; carlos charlie carl; caroline carol carrie caro lina; charlotte charlie lottie char;
christopher chris kit topher; daniel dan danny; deborah deb debbie debby debra; edward ed eddie ted ned teddy;
elizabeth liz beth eliza betty lizzie libby bess; frederick fred freddie freddy rick; gabriella gabby gabi ella;
gregory greg; harold harry hal; ingeborg inge; james jim jimmy jamie; johanna jo joanna hanna; jonas joe jon;
josephine jo josie fina; katherine kate kathy katie kat kit kay; leonora nora leo lena; marcus mark marc;
margaret maggie meg peggy madge greta rita marge; martina tina marti; michael mike mick micky mikey;
nicholas nick nicky nico claus; octavian tavi octav; oswald oz ozzie ossie; patricia pat patty tricia trish;
philippa pip pippa phil; quentin quent quin; rebecca becky becca reba; richard rich rick dick ricky;
robert rob bob bobby robbie bert; samuel sam sammy; stefan stef steve; susannah sue susie susan anna sanna;
sylvia syl sylvie silvia; theodore ted theo teddy; thomas tom tommy; ulrika ulli rika ulla; victoria vicky tori vic vickie;
walter walt wally wat; william bill will billy liam willy; yolanda yoli yola landa; zebulon zeb;
andrew andy drew; david dave; joseph joe; john jack johnny; jennifer jen jenny; kenneth ken; lawrence larry;
matthew matt; peter pete; ronald ron; stephen steve; timothy tim; catherine cathy kate; dorothy dot dolly; helen nell
"""
# Words around names that belong to nobody's name; words of organisations typed short.
TITLES = {"dr", "prof", "professor", "phd", "md", "mr", "mrs", "ms", "msc", "bsc", "sir", "jr", "sr", "dphil", "ii", "iii", "dipl", "ing", "mag"}
SHORT = {"natl": "national", "lab": "laboratory", "labs": "laboratory", "acad": "academy", "univ": "university", "inst": "institute", "dept": "department", "ctr": "centre", "cent": "centre", "center": "centre", "comm": "commission", "soc": "society", "intl": "international", "assn": "association", "res": "research", "sci": "science", "tech": "technology"}
SMALL = {"of", "for", "the", "and", "f", "de", "des", "der", "fur", "in", "on", "a", "an"}
LOOSE = {"department", "university", "faculty", "division", "group"}
_FOLD = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "þ": "th"})
_TOKEN = re.compile(r"[^\W_]+")
FULL_FORM = r"^\p{Lu}[\p{L}'-]+, \p{Lu}\p{Ll}{2,}( \p{Lu}\p{Ll}+)*$"


@cache
def nicknames() -> dict[str, set[str]]:
    return {words[0]: set(words[1:]) for line in NICKNAMES.split(";") if (words := line.split())}


def fold(s: str) -> str:
    s = unicodedata.normalize("NFKD", s.lower().translate(_FOLD))
    return "".join(c for c in s if not unicodedata.combining(c))


def distance(a: str, b: str, most: int) -> int:
    """Insertions, deletions, replacements, swaps of neighbours; most + 1 if there are more than that."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def slips(a: str, b: str) -> int | None:
    """Typing slips between two words, as far as words of that length may have any."""
    most = 0 if min(len(a), len(b)) < 4 else 1 if min(len(a), len(b)) < 12 else 2
    d = distance(a, b, most)
    return d if d <= most else None


# Costs are negative log likelihoods.
COST = {"order": 0.5, "swapped": 3.0, "initial": 1.5, "middle_left_out": 1.0, "nickname": 1.5, "prefix": 2.0, "slip": 4.0, "title": 1.0, "acronym": 2.0, "short": 0.7, "extra": 1.5, "halves": 1.0}
UNKNOWN = 11.0


def given_cost(typed: list[str], given: list[str]) -> float | None:
    """Likelihood of the typed given names; every typed one must be one of the person's, in order, the first one among them."""
    if not typed:
        return None
    if len(typed) == 1 and len(given) > 1 and 1 < len(typed[0]) <= len(given) and typed[0] == "".join(g[0] for g in given)[: len(typed[0])]:
        return COST["initial"] * len(given)
    if len(typed) > len(given):
        return None
    cost = COST["middle_left_out"] * (len(given) - len(typed))
    for t, g in zip(typed, given):
        if t == g:
            continue
        if len(t) == 1:
            if t != g[0]:
                return None
            cost += COST["initial"]
        elif t in nicknames().get(g, ()):
            cost += COST["nickname"]
        elif len(t) >= 3 and g.startswith(t) and len(g) - len(t) >= 2:
            cost += COST["prefix"]
        elif (d := slips(t, g)) is not None:
            cost += COST["slip"] * d
        else:
            return None
    return cost


def family_cost(typed: list[str], family: list[str]) -> float | None:
    """Likelihood of the typed family name, as a whole or, of a double name, its halves in the other order."""
    best = None
    orders = [(family, 0.0)] + ([(family[::-1], COST["halves"])] if len(family) == 2 else [])
    for words, cost in orders:
        a, b = "".join(typed), "".join(words)
        if len(typed) == len(words):
            parts = [slips(x, y) for x, y in zip(typed, words)]
            if None not in parts and sum(parts) <= 2:
                cost += COST["slip"] * sum(parts)
                best = cost if best is None else min(best, cost)
        elif (d := slips(a, b)) is not None:
            cost += COST["slip"] * d
            best = cost if best is None else min(best, cost)
    return best


def person_cost(spelling: str, family: str, given: str) -> float | None:
    """-log P(spelling | person), None if no reading of the spelling leads there."""
    fam, giv = _TOKEN.findall(fold(family)), _TOKEN.findall(fold(given))
    parts = [[t for t in _TOKEN.findall(fold(p)) if t not in TITLES] for p in spelling.split(",")]
    base = COST["title"] * any(t in TITLES for p in spelling.split(",") for t in _TOKEN.findall(fold(p)))
    parts = [p for p in parts if p]
    if not parts or not fam or not giv:
        return None
    readings = []
    if len(parts) >= 2:
        rest = [t for p in parts[1:] for t in p]
        readings = [(parts[0], rest, 0.0), (rest, parts[0], COST["swapped"])]
    else:
        t = parts[0]
        for n in {1, len(fam)}:
            if len(t) > n:
                readings += [(t[-n:], t[:-n], COST["order"]), (t[:n], t[n:], COST["order"])]
    best = None
    for f, g, cost in readings:
        if (a := family_cost(f, fam)) is not None and (b := given_cost(g, giv)) is not None:
            best = min(x for x in (best, base + cost + a + b) if x is not None)
    return best


def acronym(name: str) -> str:
    return "".join(t[0] for t in _TOKEN.findall(fold(name)) if t not in SMALL)


def org_cost(spelling: str, name: str) -> float | None:
    """-log P(spelling | organisation)."""
    inside = re.search(r"\(([^)]*)\)\s*$", spelling)
    if inside and fold(inside[1]).replace(".", "") == acronym(name):
        spelling = spelling[: inside.start()]
    typed = _TOKEN.findall(fold(spelling))
    if "".join(typed) == acronym(name):
        return COST["acronym"]
    words = [t for t in _TOKEN.findall(fold(name)) if t not in SMALL]
    cost, left, used = 0.0, list(words), 0
    for t in typed:
        if t in SMALL:
            continue
        full = SHORT.get(t, t)
        if full in left:
            left.remove(full)
            cost += COST["short"] * (full != t)
            used += 1
            continue
        options = [(0.0 + COST["prefix"], w) for w in left if len(t) >= 3 and w.startswith(t) and len(w) - len(t) >= 2] + [(COST["slip"] * d, w) for w in left if (d := slips(t, w)) is not None]
        if options:
            c, w = min(options)
            left.remove(w)
            cost += c
            used += 1
        elif full in LOOSE:
            cost += COST["extra"]
        else:
            return None
    left = [w for w in left if w not in LOOSE]
    if left or used < 3 or cost > 2.5 * COST["slip"]:
        return None
    return cost


def deletions(word: str) -> set[str]:
    """The word, and what is left of it after as many deletions as a word of its length may have slips: two words that `slips`
    leads to each other have one of these in common."""
    out = last = {word}
    for _ in range(0 if len(word) < 4 else 1 if len(word) < 12 else 2):
        last = {w[:k] + w[k + 1 :] for w in last for k in range(len(w))}
        out = out | last
    return out


def filing_words(kind: str, name: str, family: str | None) -> tuple[set[str], set[str]]:
    """(words, own): every spelling that a reading leads to this entity has one of the words, or each of its own words, up to
    what `akin` allows. #x stands for a whole spelling x."""
    if kind == "org":
        words = {t for t in _TOKEN.findall(fold(name)) if t not in SMALL}
        own = words - LOOSE
        return {f"#{acronym(name)}"} | (set() if own else words), own
    words = _TOKEN.findall(fold(family or name.split(",")[0]))
    if not words:
        return set(), set()
    return {max(words, key=lambda w: (len(w), w)), "".join(words)} | ({"".join(words[::-1])} if len(words) == 2 else set()), set()


def spelling_words(s: str) -> set[str]:
    """What a spelling's reading may take for a word of an entity: words, parts between commas as one word, the whole."""
    words = _TOKEN.findall(fold(s))
    parts = [p for p in ([t for t in _TOKEN.findall(fold(p)) if t not in TITLES] for p in s.split(",")) if p]
    joined = {"".join(parts[0]), "".join(t for p in parts[1:] for t in p)} if len(parts) >= 2 else set()
    last = re.search(r"\(([^)]*)\)\s*$", s)
    return {*words, *joined, "#" + "".join(words)} | ({"#" + fold(last[1]).replace(".", "")} if last else set())


def akin(typed: str, word: str) -> bool:
    """A reading may take the typed word for this one: the same, short for it, its beginning or a slip."""
    if typed == word or SHORT.get(typed) == word:
        return True
    if typed[:1] == "#" or word[:1] == "#":
        return False
    return len(typed) >= 3 and word.startswith(typed) and len(word) - len(typed) >= 2 or slips(typed, word) is not None


def typed_keys(word: str) -> set[str]:
    return {word} if word[0] == "#" else {*deletions(word), SHORT.get(word, word), f"^{word}"}


def filed_keys(word: str) -> set[str]:
    return {word} if word[0] == "#" else deletions(word) | {f"^{word[:k]}" for k in range(3, len(word) - 1)}


def _exploded(df: DataFrame, columns: list[str], words, schema: str) -> DataFrame:
    """Rows of df, once for every tuple that words(*columns) gives; schema names what the tuple holds."""
    added = [x.split() for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, t) for i, args in enumerate(zip(*(c.to_pylist() for c in b.columns))) for t in sorted(words(*args))]
            take = pa.array([i for i, _ in rows], pa.int64())
            yield pa.record_batch([c.take(take) for c in b.columns] + [pa.array([t[k] for _, t in rows], pa.bool_() if kind == "boolean" else pa.string()) for k, (_, kind) in enumerate(added)], [*b.schema.names, *(x for x, _ in added)])

    kinds = dict(df.dtypes)
    return df.select(*columns).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + f", {schema}")


def typed_words(spellings: DataFrame) -> DataFrame:
    """(spelling, typed)"""
    return _exploded(spellings, ["spelling"], lambda s: [(w,) for w in spelling_words(s)], "typed string")


def filed(canon: DataFrame) -> DataFrame:
    """(cid, word): words that spellings of an entity have one of; of an organisation's own words the one that the fewest
    organisations have, be that few or many."""

    def both(cid: str, kind: str, name: str, family: str | None) -> list[tuple[str, bool]]:
        words, own = filing_words(kind, name, family)
        return [(w, False) for w in words] + [(w, True) for w in own]

    words = materialise(_exploded(canon, ["cid", "kind", "name", "family"], both, "word string, own boolean").select("cid", "word", "own"), "filed")
    own = words.where("own")
    rarest = own.join(own.groupBy("word").agg(F.count("*").alias("c")), "word").groupBy("cid").agg(F.min(F.struct("c", "word")).alias("m"))
    return words.where("not own").select("cid", "word").unionByName(rarest.select("cid", F.col("m.word").alias("word")))


def likelihoods(typed: DataFrame, canon: DataFrame) -> DataFrame:
    """(spelling, cid, cost) for all pairs that a reading explains. typed: (spelling, typed) of typed_words. Typed words meet
    the words that entities are filed under by common deletions and beginnings, then spellings meet entities by these words."""
    words = materialise(filed(canon), "words")
    ours = _exploded(typed.select("typed").distinct(), ["typed"], lambda w: [(k,) for k in typed_keys(w)], "key string")
    theirs = _exploded(words.select("word").distinct(), ["word"], lambda w: [(k,) for k in filed_keys(w)], "key string")

    def meant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([akin(t, w) for t, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], pa.bool_()))

    met = materialise(ours.join(theirs, "key").select("typed", "word").distinct().mapInArrow(meant, "typed string, word string"), "met")
    pairs = typed.join(met, "typed").join(words, "word").select("spelling", "cid").distinct().join(canon, "cid").select("spelling", "kind", "name", "family", "given", "cid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cost = [org_cost(s, name) if kind == "org" else person_cost(s.rstrip("*† "), family, given) for s, kind, name, family, given in zip(*(b.column(c).to_pylist() for c in range(5)))]
            ok = pa.array([c is not None for c in cost], pa.bool_())
            yield pa.record_batch([b.column(0).filter(ok), b.column(5).filter(ok), pa.array([c for c in cost if c is not None], pa.float64())], ["spelling", "cid", "cost"])

    return pairs.mapInArrow(run, "spelling string, cid string, cost double")


def attribute(spellings: DataFrame, reference: DataFrame, *, min_frequency: int = 2, min_posterior: float = 0.8) -> DataFrame:
    """(spelling, entity_id, posterior). spellings: (spelling, n) distinct, with their frequency; reference: (entity_id, kind,
    name, family, given). A spelling gets the reference entity of greatest posterior if that is at least min_posterior
    beside all others and beside being nobody's; ties, spellings of unlisted people, null and blank ones get no row."""
    spellings = materialise(spellings.where(F.col("spelling").isNotNull() & (F.trim("spelling") != "")), "spellings")
    known = reference.where(F.col("name").isNotNull()).select("kind", "name", F.coalesce("family", F.substring_index("name", ",", 1)).alias("family"), F.coalesce("given", F.trim(F.regexp_extract("name", ",(.*)", 1))).alias("given"), F.concat(F.lit("E"), F.col("entity_id").cast("string")).alias("cid"))
    typed = materialise(typed_words(spellings), "typed")
    to_known = materialise(likelihoods(typed, known), "known")
    # people the reference doesn't list but who are spelled out again and again
    own = spellings.where(F.col("n") >= min_frequency).where(F.col("spelling").rlike(FULL_FORM)).join(to_known.select("spelling"), "spelling", "left_anti")
    own = own.select(F.lit("person").alias("kind"), F.col("spelling").alias("name"), F.substring_index("spelling", ",", 1).alias("family"), F.trim(F.regexp_extract("spelling", ",(.*)", 1)).alias("given"), F.concat(F.lit("U"), F.col("spelling")).alias("cid"))
    own = materialise(own, "own")
    everybody = to_known.unionByName(likelihoods(typed, own))
    prior = known.select("name", "cid").unionByName(own.select("name", "cid")).join(spellings.withColumnRenamed("spelling", "name"), "name", "left").select("cid", F.log1p(F.coalesce("n", F.lit(0)) + 1.0).alias("log_prior"))
    scored = everybody.groupBy("spelling", "cid").agg(F.min("cost").alias("cost")).join(prior, "cid").withColumn("score", F.col("log_prior") - F.col("cost"))
    per = Window.partitionBy("spelling")
    top = F.max("score").over(per)
    weight = F.exp(F.col("score") - top)
    nobody = F.exp(F.lit(-UNKNOWN) - top)
    ranked = scored.withColumn("posterior", weight / (F.sum(weight).over(per) + nobody)).where(F.col("posterior") >= min_posterior)
    return ranked.where(F.col("cid").startswith("E")).select("spelling", F.expr("cast(substr(cid, 2) as bigint)").alias("entity_id"), "posterior")


def attribute_entries(docs: DataFrame, reference: DataFrame, id_col: str = "doc_id", names_col: str = "authors", **how) -> DataFrame:
    """(id, author_pos, entity_id): entries, from 1, that denote a reference entity without being identical to its name. Null
    and empty lists, null entries and entries of unlisted people give no row; repeated documents give repeated rows only once."""
    entries = docs.select(id_col, F.posexplode(names_col).alias("_pos", "spelling")).select(id_col, (F.col("_pos") + 1).cast("int").alias("author_pos"), "spelling")
    distinct = entries.groupBy("spelling").agg(F.count("*").alias("n"))
    found = attribute(distinct, reference, **how)
    exact = reference.select(F.col("name").alias("spelling"))
    return entries.join(found, "spelling").join(exact, "spelling", "left_anti").select(id_col, "author_pos", "entity_id").distinct()
