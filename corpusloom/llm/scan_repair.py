"""P5: noise in text from scanned pages, repaired by an averaged-perceptron editor.

The editor decides three times, each time by a perceptron trained here on pages it spoils itself:
lines (text, page number, running head) from page-position features; line ends (join, leave);
characters of words (keep, replace, delete, insert). Which characters a scanner takes for which is learned, too: words of
scans that the lexicon lacks are aligned with words it has, and the edits that scans need far more often than other pages
are the editor's candidates.
"""

from __future__ import annotations

import math
import random
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import materialise

#: Bounds of the training samples: words spoilt for the character editor, chunks spoilt for lines and line ends.
TRAIN_WORDS, TRAIN_CHUNKS, EPOCHS = 4_000, 1_500, 4
#: A line form is a series' head while it has more than this many papers' scans for each of its lines on pages that are no scans.
MISSED = 2
# Words before which a hyphen at a line end belongs to a separate word.
JOINERS = {"and", "or", "to", "nor", "und", "oder", "bis", "sowie", "et", "ou", "y", "o", "e", "u", "versus"}
# Confusions that scanners are known for, read > printed: one aligned word is evidence enough for these.
KNOWN = {tuple(p.split(">")) for p in "1>l 1>i 0>o 5>s 9>g 8>b 8>s 6>b 2>z c>e j>i i>l l>i h>li li>h u>ii ii>u rn>m m>rn cl>d d>cl vv>w in>m m>in nn>m m>nn ri>n n>ri f>t t>f".split()}
WORD = re.compile(r"[^\W_]+")
#: Runs of more letters than this are no words and aren't judged.
LONGEST = 100
#: Stands where a word was joined over a line end until the lexicon tells whether it is one word or a compound.
JOINT = "\ue000"
_BROKEN = re.compile(r"[-¬\u00ad\u2010]\s*$")
_SCANNED = r"(?<=^|\n)[^\n]{30,100}(?:(?<![.!?:\s-])|(?<=\p{L}[-¬\u00ad\u2010])) ?\n *\p{Ll}"


class Perceptron:
    """Averaged perceptron over named features; a weight belongs to a feature and a class. An option's class is its name up
    to an @, so options that differ in their place only share their weights."""

    def __init__(self, classes: tuple[str, ...]) -> None:
        self.classes = classes
        self.w: dict[str, list[float]] = {}
        self.total: dict[str, list[float]] = {}
        self.at: dict[str, list[int]] = {}
        self.n = 0

    def score(self, c: int, features: list[str]) -> float:
        w = self.w
        return sum(w[f][c] for f in features if f in w)

    def best(self, options: dict[str, list[str]]) -> str:
        """options: name -> its features."""
        at = {c: k for k, c in enumerate(self.classes)}
        return max(options, key=lambda o: (self.score(at[o.partition("@")[0]], options[o]), o))

    def pick(self, features: list[str]) -> str:
        """The class of greatest score where all classes see the same features."""
        sums = [0.0] * len(self.classes)
        for f in features:
            if v := self.w.get(f):
                for k, x in enumerate(v):
                    sums[k] += x
        return self.classes[max(range(len(sums)), key=lambda k: (sums[k], self.classes[k]))]

    def learn(self, options: dict[str, list[str]], truth: str) -> None:
        self.n += 1
        guess = self.best(options)
        if guess == truth or guess.partition("@")[0] == truth.partition("@")[0] and options[guess] == options[truth]:
            return
        for o, d in ((truth, 1.0), (guess, -1.0)):
            c = self.classes.index(o.partition("@")[0])
            for f in options[o]:
                if f not in self.w:
                    self.w[f], self.total[f], self.at[f] = ([0.0] * len(self.classes), [0.0] * len(self.classes), [0] * len(self.classes))
                self.total[f][c] += (self.n - self.at[f][c]) * self.w[f][c]
                self.at[f][c] = self.n
                self.w[f][c] += d

    def average(self) -> Perceptron:
        out = Perceptron(self.classes)
        for f, v in self.w.items():
            out.w[f] = [(t + (self.n - a) * x) / max(1, self.n) for t, a, x in zip(self.total[f], self.at[f], v)]
        return out


def trained(classes: tuple[str, ...], examples: list[tuple[dict[str, list[str]], str]], seed: int = 5) -> Perceptron:
    p, rng = Perceptron(classes), random.Random(seed)
    for _ in range(EPOCHS):
        rng.shuffle(examples)
        for options, truth in examples:
            p.learn(options, truth)
    return p.average()


def is_scanned(text: Column) -> Column:
    """A line of a page's width ends inside a sentence or a word: the text kept the page's line breaks. The plain test comes
    first: most texts have no line that begins in lower case and need no walk back."""
    return F.coalesce(text.rlike(r"\n *\p{Ll}") & text.rlike(_SCANNED), F.lit(False))


# -- lines -------------------------------------------------------------------------------------------------------------

_DIGITLIKE = str.maketrans({"l": "1", "I": "1", "O": "0", "o": "0", "S": "5", "B": "8", "i": "1"})
_ROMAN = re.compile(r"c{0,3}(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})")
_PAGE_WORD = re.compile(r"(page|seite|s\.|p\.|pp\.|página|pagina|pág\.|blatt|folio|f\.)\s*", re.I)


def number_shape(line: str) -> str:
    """What a line that holds nothing but a number looks like, '' for other lines."""
    s = line.strip()
    if not s or len(s) > 24:
        return ""
    core = s.strip(" -–—~[](){}.|*·•_=<>")
    deco = "deco" if core != s else "bare"
    word = _PAGE_WORD.match(core)
    if word:
        core, deco = core[word.end() :], "word"
    parts = re.split(r"\s*(?:/|of|von|de|sur)\s*", core)
    like = [p.translate(_DIGITLIKE) for p in parts]
    if len(parts) == 2 and all(x.isdigit() and len(x) <= 5 for x in like):
        return "of"
    if len(parts) == 1 and like[0].isdigit() and len(like[0]) <= 5:
        return deco if parts[0].isdigit() else f"misread-{deco}" if any(c.isdigit() for c in parts[0]) or len(parts[0]) == 3 and set(parts[0]) <= set("lIO") else ""
    if core and core.islower() and len(core) <= 9 and _ROMAN.fullmatch(core):
        return f"roman-{deco}" if len(core) > 1 or core in "ivx" else ""
    return ""


_NO_LETTER = bytes(sorted(set(range(256)) - set(range(97, 123))))


def head_form(s: str | None) -> str:
    """As a page's head shows it: ASCII letters only, lower case."""
    return (s or "").lower().encode("ascii", "ignore").translate(None, _NO_LETTER).decode()


def without_number(line: str) -> str:
    """A line without a page number that stands at one of its ends, two blanks or more away."""
    s = re.sub(r"^\s*[\dlIO]{1,5}\s{2,}", "", line)
    return re.sub(r"\s{2,}[\dlIO]{1,5}\s*$", "", s).strip()


def line_features(lines: list[str], heads: dict[str, str], shared: set[str]) -> list[list[str]]:
    """Features of every line of a page, none for blank ones. heads: kind -> head form of title, venue, author; shared: forms
    of lines that stand on the scans of several papers."""
    shapes = [number_shape(x) for x in lines]
    full = [k for k, x in enumerate(lines) if x.strip()]
    before = {k: lines[j] for j, k in zip(full, full[1:])}
    after = {k: lines[j] for k, j in zip(full, full[1:])}
    out: list[list[str]] = [[] for _ in lines]
    plain = ""  # the last line before that is no number
    for k in full:
        line, shape = lines[k], shapes[k]
        column = sum(bool(shapes[j]) for j in (k - 2, k - 1, k + 1, k + 2) if 0 <= j < len(lines))
        f = out[k]
        f += ["bias", f"shape={shape}", f"shape={bool(shape)}&column={min(column, 2)}"]
        if shape:
            f += [f"shape={shape}&column={min(column, 2)}", f"headed={0 < len(plain) < 25 and not plain.endswith('.')}&column={min(column, 1)}"]
            continue
        plain = line.strip()
        s = without_number(line)
        form = head_form(s)
        f.append(f"numbered={s != plain}")
        told = form in shared
        for kind, h in heads.items():
            if how := head_match(form, h):
                told = True
                f.append(f"{kind}={how}")
        if form in shared:
            f.append("shared")
        small = len(s) <= 50
        f += [f"told={told}", f"small={small}", f"point={s[-1:] in '.!?;:' if s else True}", f"upper={s.isupper()}", f"small={small}&shared={form in shared}"]
        prv, nxt = before.get(k, "").strip(), after.get(k, "").strip()
        cuts = bool(prv) and prv[-1:] not in ".!?" and nxt[:1].islower()
        f += [f"first={k == 0}", f"last={k == len(lines) - 1}", f"cuts={cuts}&small={small}", f"etal={s.endswith('et al.')}&small={small}"]
    return out


def head_match(form: str, h: str) -> str:
    """How a line's form agrees with a head's, '' if it doesn't."""
    if len(form) < 5 or not h:
        return ""
    if form == h:
        return "whole"
    if h.startswith(form):
        return "start" if len(form) >= 10 else "short"
    if form.startswith(h) and len(form) - len(h) <= 4 and len(h) >= 8:
        return "more"
    return "close" if len(form) >= 12 and _close(form, h) else ""


def _close(a: str, b: str) -> bool:
    """A few characters of a were misread: it agrees with the start of b in eight of ten pairs of characters, so it has five
    characters in a row in common with b."""
    least = 0.8 * (len(a) - 1)
    if len(b) - 1 < least or not any(a[k : k + 5] in b for k in range(len(a) - 4)):
        return False
    x, y = Counter(zip(a, a[1:])), Counter(zip(b[: len(a)], b[1 : len(a)]))
    return sum((x & y).values()) >= least


def heads_of(title: str | None, venue: str | None, author: str | None) -> dict[str, str]:
    family = (author or "").split(",")[0].strip()
    return {"title": head_form(title), "venue": head_form(venue), "author": head_form(f"{family or 'anonymous'} et al.")}


LINE_CLASSES = ("text", "page_number", "running_head")


def classify_lines(lines: list[str], heads: dict[str, str], shared: set[str], model: Perceptron) -> list[str]:
    return [model.pick(f) if f else "text" for f in line_features(lines, heads, shared)]


# -- line ends ---------------------------------------------------------------------------------------------------------

END_CLASSES = ("join", "leave")


def end_features(left: str, right: str) -> list[str]:
    """left: the line up to its hyphen; right: the line after it."""
    nxt = WORD.match(right.strip())
    word = nxt.group() if nxt else ""
    last = WORD.findall(left)[-1:] or [""]
    if nxt and right.strip()[nxt.end() : nxt.end() + 1] not in ("", " "):
        word += "-"  # a conjunction stands by itself
    return ["bias", f"next={word.lower()}" if word.lower() in JOINERS or len(word) <= 3 else "next=other", f"joiner={word.lower() in JOINERS}", f"lower={word[:1].islower()}", f"any={bool(word)}", f"digit={word[:1].isdigit()}", f"before={bool(last[0])}"]


# -- characters --------------------------------------------------------------------------------------------------------


Fixes = tuple[tuple[str, str], ...]  # (read, printed)
EDIT_CLASSES = ("keep", "replace", "delete", "insert")


def edit_kind(read: str, printed: str) -> str:
    """What the editor does to what was read: as many characters, fewer, or more."""
    return "replace" if len(read) == len(printed) else "delete" if len(read) > len(printed) else "insert"


def edits_of(word: str, fixes: Fixes) -> list[tuple[int, str, str, str]]:
    """(place, read, printed, word after the edit) of every confusion that the word allows."""
    out = []
    for read, printed in fixes:
        k = word.find(read)
        while k >= 0:
            new = printed.capitalize() if read[0].isdigit() and k == 0 and len(word) > 1 else printed
            out.append((k, read, printed, word[:k] + new + word[k + len(read) :]))
            k = word.find(read, k + 1)
    return out


def slip_fixes(word: str) -> set[str]:
    """Words from which a typing slip leads to word: doubled, dropped (among doubles), swapped letters."""
    w = word.lower()
    out = {w[:k] + w[k + 1 :] for k in range(len(w) - 1) if w[k] == w[k + 1]}
    out |= {w[:k] + w[k + 1] + w[k] + w[k + 2 :] for k in range(len(w) - 1) if w[k] != w[k + 1]}
    return out - {w}


def letters(word: str) -> str:
    s = "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c))
    return "^" + re.sub("[^a-z]", "{", s) + "$"


def rareness(word: str, trigrams: dict[str, int]) -> float:
    """Least frequent trigram of the word, 0 (common) to 3 (never seen)."""
    s = letters(word)
    least = min((trigrams.get(s[k : k + 3], 0) for k in range(len(s) - 2)), default=0)
    return 3 if least == 0 else 2 if least < 3 else 1 if least < 10 else 0


def char_options(word: str, known: set[str], trigrams: dict[str, int], fixes: Fixes) -> tuple[dict[str, list[str]], dict[str, str]]:
    """(options for the perceptron, option -> word after it). known: those of the word's possible corrections that are in
    the lexicon. An option is named by the edit it makes and its place."""
    old = rareness(word, trigrams)
    slip = bool(slip_fixes(word) & known)
    mixed = any(c.isdigit() for c in word) and any(c.isalpha() for c in word)
    options, after = {"keep": ["bias", f"slip={slip}", f"old={old}", f"mixed={mixed}", f"len={min(len(word), 6)}"]}, {"keep": word}
    hits = 0
    for k, read, printed, new in edits_of(word, fixes):
        hit = new.lower() in known
        hits += hit
        now = rareness(new, trigrams)
        name = f"{edit_kind(read, printed)}@{k}:{read}>{printed}"
        options[name] = [f"edit={read}>{printed}", f"hit={hit}", f"hit={hit}&slip={slip}", f"rare={old}>{now}", f"rare={old}>{now}&hit={hit}", f"digit={read.isdigit()}&hit={hit}", f"digit={read.isdigit()}&mixed={mixed}", f"edit={read}>{printed}&hit={hit}"]
        after[name] = new
    options["keep"].append(f"hits={min(hits, 1)}")
    return options, after


def correct(word: str, known: set[str], trigrams: dict[str, int], fixes: Fixes, model: Perceptron, rounds: int = 3) -> str:
    """The word after the editor's edits, one after the other."""
    for _ in range(rounds):
        options, after = char_options(word, known, trigrams, fixes)
        choice = model.best(options)
        if choice == "keep":
            break
        word = after[choice]
        if word.lower() in known:
            break
    return word


def possible_words(word: str, fixes: Fixes) -> set[str]:
    """Corrections whose place in the lexicon the editor looks up: up to two edits, or a slip taken back."""
    one = {e[3] for e in edits_of(word, fixes)}
    two = {e[3] for w in one for e in edits_of(w, fixes)}
    return {w.lower() for w in one | two} | slip_fixes(word)


def frames(word: str) -> Iterator[tuple[str, str]]:
    """(the word with a gap, what stood in the gap) for gaps of one or two characters."""
    for n in (1, 2):
        for k in range(len(word) - n + 1):
            yield f"{word[:k]}\0{word[k + n :]}", word[k : k + n]


Edits = dict[tuple[str, str], float]  # edit that leads into the lexicon -> how frequent the word it leads to is


def expected(words: Iterable[Edits], share: Edits | None) -> Counter:
    """How many of the words need each edit, if the edits have these shares (None: equal ones)."""
    out: Counter = Counter()
    for edits in words:
        p = {e: n**0.5 * (share.get(e, 0.0) if share else 1.0) for e, n in edits.items()}
        total = sum(p.values())
        if total > 0:
            for e, x in p.items():
                out[e] += x / total
    return out


def surprise(n: float, of: int, m: float, of_others: int) -> float:
    """Log-likelihood ratio of n among `of` words and m among `of_others` against one rate for both."""
    both = (n + m) / (of + of_others)
    return 2 * sum(x * math.log(x / (both * k)) for x, k in ((n, of), (m, of_others)) if x > 0)


def learned(step: Callable[[Edits | None], Edits], typed: Callable[[list[tuple[str, str]]], Edits], n_scans: int, n_others: int, rounds: int = 20, least: float = 1.9, times: float = 8.0, usual: int = 6_000) -> Edits:
    """(read, printed) -> its count, by expectation-maximisation. step: shares -> expected counts over all odd words of scans;
    typed: edits -> expected counts over all odd words of other pages; n_scans, n_others: how many words these are.
    An edit counts if scans need it for `least` words, or for one if scanners are known for it, and `times` as often as other
    pages, where people mistype. One that scanners aren't known for must moreover be needed by `least` in `usual` words, or
    more often than on other pages by more than chance brings about among so many edits: the more words, the more edits two
    of them seem to need."""
    share, tried = None, 0
    for _ in range(rounds):
        now = {e: round(n, 9) for e, n in step(share).items() if n > 1e-6}
        tried = max(tried, len(now))
        if now == share:
            break
        share = now
    found = {e: n for e, n in sorted((share or {}).items()) if n >= (0.9 if e in KNOWN else least)}
    others = typed(list(found)) if found else {}
    out = {}
    for e, n in found.items():
        m = others.get(e, 0.0)
        usually = e in KNOWN or n >= least * n_scans / usual or surprise(n, n_scans, m, n_others) > 2 * math.log(tried)
        if usually and n * n_others >= times * m * n_scans:
            out[e] = n
    return out


def confusions(scans: dict[str, Edits], others: dict[str, Edits], **how) -> Edits:
    """`learned` from odd words of scans and of other pages with their edits."""
    return learned(lambda share: expected(scans.values(), share), lambda _: expected(others.values(), None), len(scans), len(others), **how)


# -- over tables -------------------------------------------------------------------------------------------------------


def words_of(chunks: DataFrame, text_col: str) -> DataFrame:
    """(word, n): words of all texts, lower case, with the number of texts that have them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                c.update(set(WORD.findall(t.lower())))
            if len(c) > 500_000:
                yield pa.record_batch([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["word", "n"])
                c = Counter()
        yield pa.record_batch([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["word", "n"])

    return chunks.select(text_col).where(F.length(text_col) > 0).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def aligned(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """words (scan, word) -> (scan, word, edits): edits (read, printed, frequency of the lexicon's word) of one place, up to two
    characters on either side, that lead to a word of the lexicon."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(f, gap, w, n) for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for f, gap in frames(w)]
            yield pa.record_batch([pa.array([r[k] for r in rows], pa.int64() if k == 3 else pa.string()) for k in range(4)], ["frame", "gap", "word", "n"])

    schema = "frame string, gap string, word string, n long"
    ours = words.select("word", F.col("scan").cast("long").alias("n")).mapInArrow(cut, schema).select("frame", F.col("gap").alias("read"), "word", (F.col("n") == 1).alias("scan"))
    theirs = lexicon.where(F.length("word").between(4, 24) & F.col("word").rlike(r"^\p{L}+$")).select("word", "n").mapInArrow(cut, schema).select("frame", F.col("gap").alias("printed"), "n")
    apart = (F.substring("read", 1, 1) != F.substring("printed", 1, 1)) & (F.right("read", F.lit(1)) != F.right("printed", F.lit(1)))
    met = ours.hint("merge").join(theirs, "frame").where(apart).groupBy("scan", "word", "read", "printed").agg(F.sum("n").cast("double").alias("n"))
    return met.groupBy("scan", "word").agg(F.collect_list(F.struct("read", "printed", "n")).alias("edits"))


def needed(words: DataFrame, share: Edits | None, only: set[tuple[str, str]] | None = None) -> Edits:
    """`expected` over the words (edits) of a table; only: the edits whose counts are wanted. What comes to the driver is one
    row an edit, of at most two letters on either side, however many words there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        for b in batches:
            c.update(expected(({(e["read"], e["printed"]): e["n"] for e in edits} for edits in b.column(0).to_pylist()), share))
        rows = [(*e, n) for e, n in c.items() if only is None or e in only]
        yield pa.record_batch([pa.array([r[k] for r in rows], pa.float64() if k == 2 else pa.string()) for k in range(3)], ["read", "printed", "n"])

    sums = words.select("edits").mapInArrow(run, "read string, printed string, n double").groupBy("read", "printed").agg(F.sum("n").alias("n")).toArrow()
    return {(r, p): n for r, p, n in zip(*(c.to_pylist() for c in sums.columns))}


def learn_confusions(words: DataFrame, counted: DataFrame, lexicon: DataFrame) -> Edits:
    """`learned` from all words: (word) of scans that the lexicon lacks, counted (word, n) of other pages, rare ones included."""
    usable = lambda df: df.where(F.length("word").between(4, 24) & F.col("word").rlike(r"^[\p{L}0-9]*\p{L}[\p{L}0-9]*$"))
    ours = usable(words.select(F.lower("word").alias("word")).distinct())
    theirs = usable(counted.join(lexicon.select("word"), "word", "left_anti").select("word"))
    both = materialise(ours.select(F.lit(True).alias("scan"), "word").unionByName(theirs.select(F.lit(False).alias("scan"), "word")), "both")
    n = {r["scan"]: r["count"] for r in both.groupBy("scan").count().collect()}
    found = materialise(aligned(both, lexicon), "aligned")
    # a word that one edit explains needs it whatever the shares are
    settled = needed(found.where(F.col("scan") & (F.size("edits") == 1)), None)
    undecided = materialise(found.where(F.col("scan") & (F.size("edits") > 1)), "undecided")
    step = lambda share: Counter(settled) + Counter(needed(undecided, share))
    return learned(step, lambda edits: needed(found.where(~F.col("scan")), None, set(edits)), n.get(True, 0), n.get(False, 0))


def with_known(words: DataFrame, lexicon: DataFrame, fixes: Fixes) -> DataFrame:
    """(word, known): which of a word's possible corrections the lexicon has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(w, c) for w in b.column(0).to_pylist() for c in possible_words(w, fixes)]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["w", "word"])

    hits = words.mapInArrow(run, "w string, word string").join(lexicon.select("word"), "word").groupBy("w").agg(F.collect_set("word").alias("known"))
    return words.join(hits.withColumnRenamed("w", "word"), "word", "left")


def _spoil(word: str, shares: dict[tuple[str, str], float], rng: random.Random) -> tuple[str, str] | None:
    """(spoilt word, name of the edit that repairs it), the more common confusions more often."""
    fits = [(r, p, k, n) for (r, p), n in shares.items() for k in range(len(word)) if word.startswith(p, k)]
    if not fits:
        return None
    r, p, k, _ = rng.choices(fits, [n**0.5 for *_, n in fits])[0]
    return word[:k] + r + word[k + len(p) :], f"{edit_kind(r, p)}@{k}:{r}>{p}"


def _slip(word: str, rng: random.Random) -> str:
    k = rng.randrange(len(word) - 1)
    return rng.choice([word[:k] + word[k] + word[k:], word[:k] + word[k + 1 :], word[:k] + word[k + 1] + word[k] + word[k + 2 :]])


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """About half of `most` to `most` rows, the same ones whenever df holds the same rows: a hash names them, so no task sends
    the driver more than its share of the sample."""
    every = max(1, -(-2 * df.count() // most))
    return df.where(F.pmod(F.xxhash64(key), F.lit(every)) == 0).limit(most)


def train_characters(lexicon: DataFrame, trigrams: dict[str, int], shares: dict[tuple[str, str], float]) -> Perceptron:
    """Trained on at most TRAIN_WORDS words of the lexicon, spoilt by the learned confusions (to be edited) or by typing slips,
    or left as they are though the lexicon doesn't have them (both to be kept)."""
    spark, fixes = lexicon.sparkSession, tuple(shares)
    usable = lexicon.where(F.length("word").between(4, 24) & ~F.col("word").rlike("[0-9]"))
    sample = sorted(r["word"] for r in bounded_sample(usable, "word", TRAIN_WORDS).collect())
    rng, made = random.Random(3), {}
    for w in sample:
        kind = rng.random()
        if kind < 0.55:
            if got := _spoil(w, shares, rng):
                made.setdefault(got[0], (got[1], w))
        elif kind < 0.8:
            made.setdefault(_slip(w, rng), ("keep", w))
        else:
            made.setdefault(w, ("keep", w))
    if not made:
        return Perceptron(EDIT_CLASSES).average()
    known = {r["word"]: set(r["known"] or ()) for r in with_known(spark.createDataFrame([(w,) for w in made], "word string"), lexicon, fixes).collect()}
    examples = []
    for w, (truth, origin) in made.items():
        hits = known.get(w, set()) - ({origin} if rng.random() < 0.3 else set())  # words the lexicon may lack
        options, _ = char_options(w, hits, trigrams, fixes)
        if truth in options:
            examples.append((options, truth))
    return trained(EDIT_CLASSES, examples)


def train_lines(rows: list[tuple[str, str | None, str | None, str | None]]) -> tuple[Perceptron, Perceptron]:
    """(line model, line-end model). rows: (text, title, venue, first author) of chunks that are no scans; they are wrapped
    like pages, furniture is put between their lines, columns of values and notices stay as they are."""
    rng, lines_out, ends_out = random.Random(2), [], []
    forms = ["{n}", "[{n}]", "- {n} -", "— {n} —", "~ {n} ~", "Page {n}", "Seite {n}", "p. {n} of {m}", "{n}/{m}", ". {n}", "({n})", "{r}", "{s}", "{blank}{n}"]
    for text, title, venue, author in rows:
        heads = heads_of(title, venue, author)
        out: list[tuple[str, str]] = []
        for part in text.split("\n"):
            if len(part) < 100:
                out.append((part, "text"))
                continue
            width, line = rng.randint(50, 74), ""
            for word in part.split(" "):
                if len(line) + len(word) > width:
                    out.append((line, "text"))
                    line = word
                else:
                    line = f"{line} {word}".strip()
            out.append((line, "text"))
        number = rng.randint(1, 400)
        shared: set[str] = set()
        if rng.random() < 0.6:
            roman = "".join(("x" * (number // 10 % 4), ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"][number % 10]))
            form = rng.choice(forms).format(n=number, m=number + 80, r=roman or "x", s=str(number).replace("1", "l").replace("0", "O"), blank=" " * 30)
            out.insert(rng.randrange(len(out) + 1), (form, "page_number"))
        if rng.random() < 0.6:
            kind, value = rng.choice([("title", title), ("venue", venue), ("author", f"{author.split(',')[0]} et al." if author else None), ("series", "Papers of the Society")])
            if value:
                head = "".join(c for c in value if c.isascii() and (c.isalpha() or c == " ")) if kind == "title" else value
                head = head[: rng.randint(24, 60)].strip()
                head = head.upper() if rng.random() < 0.3 else head
                head = rng.choice([head, head, f"{number}   {head}", f"{head}   {number}"])
                if kind == "series" or rng.random() < 0.5:
                    shared.add(head_form(without_number(head)))
                out.insert(rng.randrange(len(out) + 1), (head, "running_head"))
        if rng.random() < 0.25:
            start, step = rng.randint(1, 900), rng.randint(1, 30)
            column = [str(start + step * k) for k in range(rng.randint(3, 7))] if rng.random() < 0.7 else ["i", "ii", "iii", "iv", "v"]
            at = rng.randrange(len(out) + 1)
            out[at:at] = [(x, "text") for x in [rng.choice(["Year", "n", "Depth (cm)", "Station", "Count"]), *column]]
        texts = [x for x, _ in out]
        for f, (_, truth) in zip(line_features(texts, heads, shared), out):
            if f:
                lines_out.append((dict.fromkeys(LINE_CLASSES, f), truth))
        words = WORD.findall(text)
        for k in range(0, len(words) - 1, 7):
            if len(words[k]) >= 6:
                cut = rng.randint(2, len(words[k]) - 2)
                ends_out.append((dict.fromkeys(END_CLASSES, end_features(words[k][:cut], words[k][cut:])), "join"))
                ends_out.append((dict.fromkeys(END_CLASSES, end_features(words[k], rng.choice(["and", "or", "und", "oder", "et", "ou", "y", "o", "to"]) + " x")), "leave"))
    return trained(LINE_CLASSES, lines_out), trained(END_CLASSES, ends_out)


def read_page(text: str, heads: dict[str, str], shared: set[str], lines_model: Perceptron, ends_model: Perceptron) -> tuple[str, set[str]]:
    """(text without furniture, its lines joined to paragraphs, JOINT where a word was broken; the defects met)."""
    lines = text.split("\n")
    kinds = classify_lines(lines, heads, shared, lines_model)
    defects = {k for k in kinds if k != "text"}
    kept = [x for x, k in zip(lines, kinds) if k == "text"]
    out: list[str] = []
    width = sorted(len(x) for x in kept)[len(kept) * 3 // 4] if kept else 0
    open_line = False
    for k, line in enumerate(kept):
        if out and open_line:
            left = out[-1]
            m = _BROKEN.search(left)
            if m and ends_model.pick(end_features(left[: m.start()], line)) == "join":
                defects.add("hyphen_break")
                out[-1] = left[: m.start()] + JOINT + line.strip()
            else:
                out[-1] = f"{left.rstrip()} {line.strip()}"
        else:
            out.append(line)
        # a paragraph ends with a full stop on a line clearly shorter than the page is wide, or at a line too long to be wrapped
        open_line = bool(_BROKEN.search(line)) or (len(line) <= 100 and (line.rstrip()[-1:] not in ".!?:" or len(line) >= 0.8 * width) and len(line) > 25)
    return "\n".join(out), defects


def odd_words(pages: DataFrame, lexicon: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(odd, compounds), both (_id, word): words of the pages that the lexicon lacks, and words broken at a line end that it
    lacks as a whole but knows both parts of. A JOINT inside a word stays in compounds only."""
    token = rf"(?<![\p{{L}}\p{{N}}{JOINT}:/.])[\p{{L}}\p{{N}}{JOINT}]+(?![\p{{N}}/])"
    tokens = pages.select("_id", F.explode(F.array_distinct(F.regexp_extract_all("clean", F.lit(token), F.lit(0)))).alias("_typed")).withColumn("word", F.replace("_typed", F.lit(JOINT), F.lit("")))
    tokens = tokens.where(F.col("word").rlike(r"\p{L}") & F.length("word").between(3, LONGEST) & ~F.col("word").rlike(r"^[A-Z]{1,3}[0-9]+[A-Z]?$|^[0-9]+$|[0-9]{3}"))
    known = lexicon.select(F.col("word").alias("_low"))
    odd = materialise(tokens.withColumn("_low", F.lower("word")).join(known, "_low", "left_anti").select("_id", "word", "_typed"), "odd")
    broken = odd.where(F.contains("_typed", F.lit(JOINT))).select("_typed").distinct()
    parts = broken.select("_typed", F.explode(F.split(F.lower("_typed"), JOINT)).alias("_low")).where(F.length("_low") >= 3).join(known, "_low", "left_semi")
    both = parts.groupBy("_typed").agg(F.count("*").alias("n")).where(F.col("n") == F.size(F.split("_typed", JOINT))).select("_typed")
    compounds = odd.join(both, "_typed", "left_semi").select("_id", F.col("_typed").alias("word"))
    return odd.join(both, "_typed", "left_anti").select("_id", "word"), compounds


def prepared(chunks: DataFrame, meta: DataFrame, id_col: str = "chunk_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, words, compounds). pages (_id, clean, defects): the scans without furniture; words (_id, word, fixed): misread
    words; compounds (_id, word): words broken at their hyphen."""
    rows = chunks.select(F.col(id_col).alias("_id"), F.col("doc_id").alias("_doc"), F.col("text").alias("_text")).where(F.length("_text") > 0)
    about = meta.select(F.col("doc_id").alias("_doc"), "title", "venue", F.get("authors", F.lit(0)).alias("author")).dropDuplicates(["_doc"])
    plain = rows.where(~is_scanned(F.col("_text")))
    counted = materialise(words_of(plain, "_text"), "lexicon")
    lexicon = counted.where("n >= 3").hint("merge")  # grows with the corpus, so it isn't broadcast
    padded = F.concat(F.lit("^"), F.regexp_replace("word", "[^a-z]", "{"), F.lit("$"))
    grams = lexicon.select(F.explode(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda k: F.substr(padded, k, F.lit(3)))).alias("g")).groupBy("g").agg(F.count("*").alias("n"))
    trigrams = {r["g"]: r["n"] for r in grams.collect()}  # at most 29 ** 3
    # chosen by a hash of the id first, so only the sample's texts are looked at
    total = chunks.count()
    few = rows.where(F.pmod(F.xxhash64("_id"), F.lit(max(1, -(-total // TRAIN_CHUNKS)))) == 0).where(~is_scanned(F.col("_text"))).limit(TRAIN_CHUNKS)
    sample = few.join(about, "_doc", "left").select("_id", "_text", "title", "venue", "author").collect()
    lines_model, ends_model = train_lines([tuple(r)[1:] for r in sorted(sample, key=lambda r: str(r["_id"]))])

    scans = materialise(rows.where(is_scanned(F.col("_text"))).join(about, "_doc", "left"), "scans")
    # heads of a series: the same short line on the scans of several papers, and hardly ever on a page that is no scan
    form = lambda c: F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s*[\dlIO]{1,5}\s{2,}|\s{2,}[\dlIO]{1,5}\s*$", "")), "[^a-z]+", "")
    short = scans.select("_id", "_doc", F.explode(F.split("_text", "\n")).alias("_line")).where(F.length("_line").between(8, 60) & ~F.col("_line").rlike(r"[.!?;,]\s*$")).select("_id", "_doc", form(F.col("_line")).alias("_form")).where(F.length("_form") >= 8)
    often = materialise(short.groupBy("_form").agg(F.approx_count_distinct("_doc").alias("d")).where("d >= 3"), "often")
    seen = plain.select(F.explode(F.split("_text", "\n")).alias("_line")).where(F.length("_line").between(8, 60)).select(form(F.col("_line")).alias("_form"))
    elsewhere = seen.join(often.select("_form"), "_form", "left_semi").groupBy("_form").agg(F.count("*").alias("n"))
    # is_scanned misses a few scans, so a head may stand on "no scans" too; a notice stands there at least half as often
    series = often.join(elsewhere, "_form", "left").where(F.coalesce("n", F.lit(0)) * MISSED < F.col("d")).select("_form")
    shared = short.join(series, "_form", "left_semi").groupBy("_id").agg(F.collect_set("_form").alias("_shared"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean, defects = [], []
            for text, title, venue, author, forms in zip(*(b.column(k).to_pylist() for k in range(1, 6))):
                c, d = read_page(text, heads_of(title, venue, author), set(forms or ()), lines_model, ends_model)
                clean.append(c)
                defects.append(sorted(d))
            yield pa.record_batch([b.column(0), pa.array(clean, pa.string()), pa.array(defects, pa.list_(pa.string()))], ["_id", "clean", "defects"])

    kind = dict(scans.dtypes)["_id"]
    pages = materialise(scans.join(shared, "_id", "left").select("_id", "_text", "title", "venue", "author", "_shared").mapInArrow(run, f"_id {kind}, clean string, defects array<string>"), "pages")
    # words the lexicon doesn't have, each judged once
    odd, compounds = odd_words(pages, lexicon)
    words = odd.select("word").distinct()
    shares = learn_confusions(words, counted, lexicon)
    fixes = tuple(shares)
    editor = train_characters(lexicon, trigrams, shares)

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fixed = [correct(w, set(k or ()), trigrams, fixes, editor) for w, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.record_batch([b.column(0), pa.array(fixed, pa.string())], ["word", "fixed"])

    changed = with_known(words, lexicon, fixes).select("word", "known").mapInArrow(edit, "word string, fixed string").where("word != fixed")
    return pages, materialise(odd.join(changed, "word").select("_id", "word", "fixed"), "fixes"), compounds


def defects_of(chunks: DataFrame, meta: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """(id, defect) of chunks from scanned pages: hyphen_break, misread, page_number, running_head. Null, empty and unwrapped
    texts have none; a chunk whose paper is unknown is judged without its heads; id must be unique."""
    pages, words, _ = prepared(chunks, meta, id_col)
    return pages.select("_id", F.explode("defects").alias("defect")).unionByName(words.select("_id", F.lit("misread").alias("defect"))).distinct().withColumnRenamed("_id", id_col)


def repaired(chunks: DataFrame, meta: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """(id, repaired) for every chunk: scans without furniture, as paragraphs, their misread words edited, words that were
    broken at their hyphen with it; others as they are."""
    pages, words, compounds = prepared(chunks, meta, id_col)
    both = words.unionByName(compounds.select("_id", "word", F.replace("word", F.lit(JOINT), F.lit("-")).alias("fixed")))
    fixes = both.groupBy("_id").agg(F.map_from_entries(F.collect_set(F.struct("word", "fixed"))).alias("_fix"))
    token = re.compile(rf"(?:[^\W_]|{JOINT})+")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, f in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                fix = dict(f or ())
                one = lambda m, fix=fix: fix.get(m.group()) or fix.get(m.group().replace(JOINT, "")) or m.group().replace(JOINT, "")
                out.append(token.sub(one, t) if fix or JOINT in t else t)
            yield pa.record_batch([b.column(0), pa.array(out, pa.string())], ["_id", "repaired"])

    done = pages.join(fixes, "_id", "left").select("_id", "clean", "_fix").mapInArrow(put, f"_id {dict(pages.dtypes)['_id']}, repaired string")
    return chunks.select(F.col(id_col).alias("_id"), "text").join(done, "_id", "left").select(F.col("_id").alias(id_col), F.coalesce("repaired", "text").alias("repaired"))
