"""Texts read in a wrong character encoding: found and restored with mappings learned from near-twins.

The corpus is reduced to its distinct forms: words with a character beyond ASCII, with the number of
distinct texts that hold them. Forms that agree on what is left without such characters are near-twins;
where one is the garbled side, their characters are aligned, and the alignments vote for
transformations: bytes of one encoding read as another, once or twice over. Words wholly beyond ASCII
leave nothing to join on; there the transformed form itself is looked up. Transformations with enough
votes are then applied to every form of the corpus, and a form that equals the garbled image of another
is garbled if it is the worse word of the two (``flaw``), else if most texts that hold it hold words
garbled in the same way, else if the other is much more frequent. What no twin explains counts as
garbled by its characters alone: replacement marks, control codes, sequences that a learned
transformation turns back into the corpus's own alphabet.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize, parallelism, ship

ship(sys.modules[__name__])

#: The encodings among which texts are mixed up, by Python's names.
ENCODINGS = ["utf-8", "cp1252", "iso8859-1", "cp1250", "iso8859-2", "cp1251", "koi8-r", "iso8859-5", "cp866", "mac-cyrillic", "mac-roman", "cp437", "cp850", "cp852", "iso8859-15", "cp1253", "cp1254", "cp1257"]
#: Those in which text is read wrongly twice over.
TWICE = ["cp1252", "iso8859-1", "cp1250", "cp1251", "mac-roman", "cp437", "cp850"]
#: A transformation is a chain of (true encoding, encoding read in).
TRANSFORMATIONS = [((t, w),) for t in ENCODINGS for w in ENCODINGS if t != w] + [(("utf-8", a), ("utf-8", b)) for a in TWICE for b in TWICE]
MARK = "�"
#: A transformation is chosen for at least this share of all forms that have an explanation: a few forms of a large
#: corpus look by chance as if they were garbled.
LEAST_SHARE = 0.0005

FORM = r"[A-Za-z0-9]*+[^\x00-\x7F][A-Za-z0-9\x80-\U0010FFFF]*+"
#: Marks that stand before or after a word without being part of it.
AROUND = "^[“”„«»‘’¿¡–—…\u00a0]+|[“”„«»‘’–—…\u00a0]+$"
#: A sequence quoted by itself, as an example. Its quote marks border on ASCII, spaces or the text's edge: within a
#: garbled run they're bytes of letters. A hard space may be such a byte too.
SPACES = r"\u2000-\u200a\u202f\u3000"
QUOTED = rf"""(?<![^\x00-\x7F{SPACES}])(?:["“„«]\s?[^\x00-\x7F]+?\s?["”“»]|(?<![A-Za-z0-9])['‘`(][^\x00-\x7F]+?['’`)](?![A-Za-z0-9]))(?![^\x00-\x7F{SPACES}])"""


#: What was worked out once in this process (plain dicts, as these functions travel by value).
_tables: dict[str, tuple[list[str], dict[str, int]]] = {}
_runs: dict[str, dict[str, set[int]]] = {}


def _table(encoding: str) -> tuple[list[str], dict[str, int]]:
    """Characters of the 256 bytes, and back. Bytes without a character stand for the control code of that number."""
    if encoding in _tables:
        return _tables[encoding]
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            chars.append(chr(b))
    _tables[encoding] = chars, {c: b for b, c in reversed([*enumerate(chars)])}
    return _tables[encoding]


def _encode(text: str, encoding: str) -> bytes | None:
    if encoding == "utf-8":
        return text.encode("utf-8", "surrogatepass")
    back = _table(encoding)[1]
    try:
        return bytes([back[c] for c in text])
    except KeyError:
        return None


class _Turns(dict):
    """Translation of characters; those that the true encoding lacks become NONE."""

    def __missing__(self, _: int) -> str:
        return NONE


NONE = "\uffff"
_turns: dict[tuple[str, str], _Turns] = {}


def _turn(true: str, read: str) -> _Turns:
    """How each character of an encoding of one byte looks when it's read in another; of utf-8, how each of its bytes looks."""
    if (true, read) not in _turns:
        chars = _table(read)[0]
        _turns[true, read] = _Turns(enumerate(chars)) if true == "utf-8" else _Turns((ord(c), chars[b]) for c, b in _table(true)[1].items())
    return _turns[true, read]


def garble(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """A text as it looks after it was read wrongly; None where it couldn't have been."""
    for true, read in chain:
        if read == "utf-8":
            raw = _encode(text, true)
            if raw is None:
                return None
            text = raw.decode("utf-8", "replace")
        elif true == "utf-8":
            text = text.encode("utf-8", "surrogatepass").decode("latin-1").translate(_turn(true, read))
        else:
            text = text.translate(_turn(true, read))
            if NONE in text:
                return None
    return text


def restore(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The inverse of garble; None where the text can't have come from it."""
    for true, read in reversed(chain):
        raw = _encode(text, read)
        if raw is None:
            return None
        if true == "utf-8":
            try:
                text = raw.decode("utf-8")
            except UnicodeDecodeError:
                return None
        else:
            text = "".join(map(_table(true)[0].__getitem__, raw))
    return text


def multibyte(chain: tuple[tuple[str, str], ...]) -> bool:
    return chain[0][0] == "utf-8"


def looks(garbled: str, chain: tuple[tuple[str, str], ...]) -> set[str]:
    """How a garbled form may stand in a text: as it is; where one character became several, also without invisible
    ones, or cut at a hard space."""
    if not multibyte(chain):
        return {garbled}
    bare = re.sub("[\x80-\x9f\xad\u200b]", "", garbled)
    out = {garbled, bare, *re.split("[\xa0 ]", bare)}
    return {x for x in out if re.search(r"[^\x00-\x7f]", x)}


def gaps(form: str) -> list[str]:
    """What stands before, between and after the ASCII characters of a form."""
    return re.split(r"[\x00-\x7f]", form)


def explain(clean: str, garbled: str) -> list[int]:
    """Numbers of the transformations that turn one form into its near-twin, by aligned characters."""
    pairs = [(c, g) for c, g in zip(gaps(clean), gaps(garbled), strict=True) if c or g]
    if any(not c or not g for c, g in pairs):
        return []
    out: set[int] | None = None
    for c, g in pairs:
        out = _by_run(c).get(g, set()) if out is None else out & _by_run(c).get(g, set())
        if not out:
            return []
    return sorted(out or ())


def _by_run(run: str) -> dict[str, set[int]]:
    """Every look of a run of characters under every transformation."""
    if run in _runs:
        return _runs[run]
    out: dict[str, set[int]] = {}
    for k, chain in enumerate(TRANSFORMATIONS):
        g = garble(run, chain)
        if g is not None and g != run and MARK not in g:
            for x in looks(g, chain):
                out.setdefault(x, set()).add(k)
    if len(_runs) < 100_000:
        _runs[run] = out
    return out


#: Marks that stand inside words, and those that stand before or after words or numbers.
INSIDE, BESIDE = frozenset("’‘ʼ·–—…\u00a0\u200b\u200c\u200d"), frozenset("“”„«»‘’¿¡–—…\u00a0°€£¥¢§©®™•×²³¹ªº")
_flaws: dict[str, int] = {}


def flaw(form: str) -> int:
    """What is wrong with a form as a word, whatever its frequency: 0 nothing, 1 symbols among its letters, a capital
    after a small letter, or letters of several scripts, 2 control codes or replacement marks."""
    if form in _flaws:
        return _flaws[form]
    out = 2 if re.search("[\x80-\x9f�]", form) else int(_unlike(form))
    if len(_flaws) < 200_000:
        _flaws[form] = out
    return out


def _unlike(form: str) -> bool:
    scripts = set()
    for i, c in enumerate(form):
        before, after = form[i - 1 : i], form[i + 1 : i + 2]
        if c.isalpha() and c not in "ªºµ":
            scripts.add("LATIN" if c < "\x80" else unicodedata.name(c, "?").split()[0])
            if c.isupper() and before.islower() and not (c + before).isascii():
                return True
        elif c > "\x7f" and unicodedata.category(c)[0] != "M" and unicodedata.category(c) != "Nd":
            if before.isalpha() and after.isalpha():
                if c not in INSIDE:
                    return True
            elif c not in BESIDE and (before.isalpha() or after.isalpha()):
                return True
    return len(scripts) > 1


#: What every quoted example begins with: most texts hold none, and this is looked for faster than the whole.
_maybe = re.compile(r"""["“„«'‘`(]\s?[^\x00-\x7F]""")
_run = re.compile(r"[A-Za-z0-9\x80-\U0010FFFF]+")
_form, _quoted, _around, _digits = re.compile(FORM), re.compile(QUOTED), re.compile(AROUND), re.compile("[0-9]+")
_variants: dict[str, tuple[str, ...]] = {}


def variants(run: str) -> tuple[str, ...]:
    """Forms that a run in a text counts as; digits are all 0.

    A run with hard spaces counts as a whole and by its words (a hard space may be a garbled letter), and a word with
    marks around it counts with and without them.
    """
    out = _variants.get(run)
    if out is None:
        form = _digits.sub("0", run)
        words = [form, *form.split("\xa0")] if "\xa0" in form else [form]
        out = tuple(dict.fromkeys(x for w in words for x in (w, _around.sub("", w)) if not x.isascii()))
        if len(run) < 64 and len(_variants) < 200_000:
            _variants[run] = out
    return out


def _forms(text: str) -> set[str]:
    """Runs of letters, digits and characters beyond ASCII that hold one of the latter (``FORM``), as they count."""
    return {x for run in set(_run.findall(text)) if not run.isascii() for x in variants(run)}


def forms_in(text: str) -> set[str]:
    """Distinct forms of a text. Quoted examples don't count."""
    return set() if text.isascii() else _forms(_quoted.sub(" ", text) if _maybe.search(text) else text)


def quoted_in(text: str) -> set[str]:
    """Distinct forms that stand in a text as quoted examples only. They count where the rest of the text is garbled."""
    return set() if text.isascii() or not _maybe.search(text) or not _quoted.search(text) else _forms(text) - forms_in(text)


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text (form empty) and for each of its forms."""
    for b in batches:
        ids, digests = b.column("doc_id"), b.column("digest")
        of, forms, quoted = [], [], []
        for i, text in enumerate(b.column("text").to_pylist()):
            found, also = forms_in(text), quoted_in(text)
            of += [i] * (1 + len(found) + len(also))
            forms += ["", *found, *also]
            quoted += [False] * (1 + len(found)) + [True] * len(also)
        at = pa.array(of, pa.int32())
        yield pa.RecordBatch.from_arrays([ids.take(at), digests.take(at), pa.array(forms, pa.string()), pa.array(quoted, pa.bool_())], names=["doc_id", "digest", "form", "quoted"])


def picked(documents: DataFrame) -> DataFrame:
    """(doc_id, digest, form, quoted): the forms of each text beyond ASCII, from the one pass over the corpus, as a written
    table. A row without form stands for the text itself."""
    texts = documents.where(F.octet_length("text") > F.length("text")).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text")
    return materialize(texts.mapInArrow(_pick, "doc_id long, digest long, form string, quoted boolean"), "picked")


def _with_flaws(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.assign(flaw=[flaw(f) for f in b["form"]])


def corpus_forms(picks: DataFrame) -> DataFrame:
    """(form, n, flaw, skeleton): distinct forms and the number of distinct texts that hold them, 0 for quoted examples.

    Each of m equal texts counts 1/m: only digests that are there several times join the forms.
    """
    copies = picks.where("form = ''").groupBy("digest").agg(F.count("*").alias("copies")).where("copies > 1")
    rows = picks.where("form <> ''").join(copies, "digest", "left")
    n = F.round(F.sum(F.when(F.col("quoted"), 0.0).otherwise(1 / F.coalesce("copies", F.lit(1))))).cast("long")
    forms = rows.groupBy("form").agg(n.alias("n")).mapInPandas(_with_flaws, "form string, n long, flaw int")
    return forms.withColumn("skeleton", F.regexp_replace("form", r"[^\x00-\x7F]+", ""))


def _votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(k, f) for c, f in zip(b["clean"], b["form"], strict=True) for k in explain(c, f)]
        yield pd.DataFrame(rows, columns=["chain", "form"])


def _images(chains: tuple[int, ...], ratio: float):
    def images(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for seen, n in zip(b["form"], b["n"], strict=True):
                # What is known in one letter case is known in others.
                for clean in dict.fromkeys((seen, seen.upper(), seen[:1].upper() + seen[1:])):
                    bad = flaw(clean)
                    if bad and n < ratio:
                        continue
                    for k in chains:
                        g = garble(clean, TRANSFORMATIONS[k])
                        if g is not None and g != clean:
                            for x in looks(g, TRANSFORMATIONS[k]):
                                # The better word is never the garbled one; a piece cut at a hard space is no word.
                                piece = "\xa0" in g and "\xa0" not in x or x != g and not flaw(x)
                                if x != clean and flaw(x) >= bad and (n >= ratio or flaw(x) and not piece):
                                    rows.append((x, clean, seen, n, bad, piece, k))
            yield pd.DataFrame(rows, columns=["form", "clean", "seen", "n_clean", "flaw_clean", "piece", "chain"])

    return images


IMAGES = "form string, clean string, seen string, n_clean long, flaw_clean int, piece boolean, chain int"


def _worse() -> Column:
    """The form is unlike a word, its clean image isn't: it is garbled, however frequent it may be."""
    return (F.col("flaw_clean") == 0) & (F.col("flaw") > 0)


def _rarer(ratio: float) -> Column:
    """Neither is the better word, and the clean one is in many more texts."""
    return (F.col("flaw") >= F.col("flaw_clean")) & (F.col("n_clean") >= ratio * F.greatest("n", F.lit(1)))


def _capitals(form: str) -> Column:
    return (F.length(form) >= 3) & (F.col(form) == F.upper(form)) & (F.col(form) != F.lower(form))


def _vote(ratio: float) -> Column:
    """Which pairs (clean, form) vote. Of two words alike, the one in capitals is the garbled one: text is mostly in small
    letters. That is enough for a vote, not to call a single word garbled."""
    return _worse() | (_rarer(ratio) & (_capitals("form") | ~_capitals("clean"))) | ((F.col("flaw") == F.col("flaw_clean")) & _capitals("form") & ~_capitals("clean"))


def _chosen_in_rounds(sets: DataFrame, votes: int) -> list[int]:
    """The same choice as on the driver; a round brings one number a transformation there."""
    chosen: list[int] = []
    while True:
        left = sets.where(~F.arrays_overlap("chains", F.array(*map(F.lit, chosen)))) if chosen else sets
        best = left.select("n", F.explode("chains").alias("chain")).groupBy("chain").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "chain").first()
        if best is None or best.n < votes:
            return chosen
        chosen.append(best.chain)


def learn(forms: DataFrame, *, ratio: float = 5.0, votes: int = 3, most_sets: int = 20_000) -> list[int]:
    """Numbers of the transformations at work in a corpus: as few as explain what can be explained.

    Votes come from near-twins, forms with the same ASCII characters and gaps, each with each, and for forms that have hardly any from the look-up of whole forms. A
    clean twin is the better word, or as good a one in ``ratio`` times as many texts (``_vote``). Transformations are chosen one after another by the number of
    forms that only they explain among those chosen so far, down to ``votes`` and to LEAST_SHARE of all explained forms. All forms count: the ways in which forms
    can be explained are tallied on the driver up to ``most_sets`` of them, and by a job a round beyond.
    """
    letters = F.length(F.regexp_replace("skeleton", "[0-9]", ""))
    sound = ~F.col("form").rlike("[\x80-\x9f�]")
    forms = forms.where("n > 0")
    twins = forms.where(letters >= 2)
    twins = twins.withColumn("shape", F.regexp_replace("form", r"[^\x00-\x7F]+", "\u0001"))
    clean = twins.where(sound).select("shape", F.col("form").alias("clean"), F.col("n").alias("n_clean"), F.col("flaw").alias("flaw_clean"))
    pairs = twins.join(clean, "shape").where((F.col("form") != F.col("clean")) & _vote(ratio)).select("form", "clean")
    by_twin = pairs.mapInPandas(_votes, "chain int, form string")
    whole = forms.where((letters < 2) & (F.length("form") - F.length("skeleton") >= 4))
    by_look = whole.where(sound & (F.col("n") >= ratio)).select("form", "n").repartition(parallelism(forms.sparkSession)).mapInPandas(_images(tuple(range(len(TRANSFORMATIONS))), ratio), IMAGES).where(~F.col("form").contains(MARK))
    by_look = by_look.hint("merge").join(whole.select("form", "n", "flaw"), "form").where(_vote(ratio)).select("chain", "form")
    # How many forms each set of transformations explains; there are as many sets as ways in which encodings overlap.
    sets = by_twin.unionByName(by_look).groupBy("form").agg(F.array_sort(F.collect_set("chain")).alias("chains")).groupBy("chains").agg(F.count("*").alias("n"))
    sets = materialize(sets, "ways")
    votes = max(votes, math.ceil(LEAST_SHARE * sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]))
    if sets.limit(most_sets + 1).count() > most_sets:
        return sorted(_chosen_in_rounds(sets, votes))
    left = {frozenset(r.chains): r.n for r in sets.collect()}  # most_sets at most
    chosen = []
    while left:
        tally: dict[int, int] = {}
        for chains, n in left.items():
            for k in chains:
                tally[k] = tally.get(k, 0) + n
        best = max(tally, key=lambda k: (tally[k], -k))
        if tally[best] < votes:
            break
        chosen.append(best)
        left = {c: n for c, n in left.items() if best not in c}
    return sorted(chosen)


def _unexplained(chains: tuple[int, ...], alphabet: frozenset[str]):
    """Forms without twin that are garbled by their characters alone."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for form in b["form"]:
                clean, by = None, None
                for k in chains:
                    chain = TRANSFORMATIONS[k]
                    if not multibyte(chain):
                        continue
                    back = [restore(g, chain) if g else "" for g in gaps(form)]
                    done = [g for g in back if g]
                    # The sequence must be an odd one: not all letters, or letters of several scripts.
                    if None not in back and done and all(c in alphabet for g in done for c in g) and _odd(form):
                        ascii_ = re.findall(r"[\x00-\x7f]", form)
                        clean, by = "".join(g + a for g, a in zip(back, [*ascii_, ""], strict=True)), k
                        break
                if clean is not None or MARK in form or re.search("[\x80-\x84\x86-\x9f]", form):
                    rows.append((form, clean, by))
            yield pd.DataFrame(rows, columns=["form", "clean", "chain"]).astype({"chain": "Int32"})

    return judge


def _odd(form: str) -> bool:
    """Holds characters that words don't: symbols or control codes beside letters, or letters of several scripts."""
    beyond = [c for c in form if ord(c) > 127]
    kinds = {unicodedata.category(c)[0] for c in beyond}
    scripts = {unicodedata.name(c, "?").split()[0] for c in form if c.isalpha()}
    return bool(kinds - {"L"}) or len(scripts) > 1


def _beside(picks: DataFrame, images: DataFrame, worse: DataFrame) -> DataFrame:
    """Images as good as their clean form, where most texts that hold them hold worse ones of the same transformation."""
    sure = worse.select("form", "chain").distinct()
    open_ = images.where("not worse and not piece").join(sure.select("form").distinct(), "form", "left_anti").join(sure.select("chain").distinct(), "chain", "left_semi")
    rows = picks.where("form <> '' and not quoted").select("digest", "form")
    spoilt = materialize(rows.join(sure, "form").select("digest", "chain").distinct(), "spoilt")
    held = rows.join(open_.select("form", "n", "chain").distinct(), "form").join(spoilt, ["digest", "chain"], "left_semi").distinct()
    share = held.groupBy("form", "chain", "n").agg(F.count("*").alias("spoilt")).where(2 * F.col("spoilt") > F.col("n"))
    return open_.join(share.select("form", "chain"), ["form", "chain"], "left_semi").select(*images.columns)


def garbled_forms(picks: DataFrame, *, ratio: float = 5.0, votes: int = 3) -> DataFrame:
    """Garbled forms of a corpus (``picked``): (form, clean, chain), a written table. clean is null where nothing tells the original."""
    forms = materialize(corpus_forms(picks), "forms")
    chains = tuple(learn(forms, ratio=ratio, votes=votes))
    marks = [k for k, c in enumerate(TRANSFORMATIONS) if c[-1][1] == "utf-8"]  # bytes that were no UTF-8: replacement marks
    images = forms.where((F.col("n") > 0) & ~F.col("form").rlike("[\x80-\x9f�]")).select("form", "n").repartition(parallelism(forms.sparkSession)).mapInPandas(_images(tuple(sorted({*chains, *marks})), ratio), IMAGES)
    images = images.where(F.col("chain").isin(*chains) | F.col("form").contains(MARK))
    # Images outnumber the forms that Spark takes them for: they're shuffled, never broadcast.
    found = images.hint("merge").join(forms, "form")
    beyond = F.length("form") - F.length("skeleton")
    many = F.col("chain").isin(*[k for k, c in enumerate(TRANSFORMATIONS) if multibyte(c)]) | F.col("form").contains(MARK)
    # One byte for one: too little is left of a very short form to tell it from a word of its own.
    found = found.where(many | (beyond >= 3) | (F.length("skeleton") >= 1))
    found = materialize(found.select("form", "n", "clean", "seen", "n_clean", "chain", "piece", (_worse() & ~F.col("piece")).alias("worse"), _rarer(ratio).alias("rarer")), "images")
    worse = found.where("worse")
    beside = _beside(picks, found, worse)
    sure = materialize(worse.unionByName(beside).select("form", "clean", "seen", "n_clean", "chain"), "sure")
    rarer = found.where("rarer").join(sure.select("form").distinct(), "form", "left_anti").select(*sure.columns)
    found = sure.unionByName(rarer)
    # What is garbled itself tells nothing of others: its images may be sound words.
    found = found.join(found.select(F.col("form").alias("seen")).distinct(), "seen", "left_anti")
    found = found.groupBy("form").agg(F.max(F.struct("n_clean", "clean", "chain")).alias("best")).select("form", F.col("best.clean").alias("clean"), F.col("best.chain").alias("chain"))
    # The corpus's own alphabet beyond ASCII: at most one row for each character there is.
    total = forms.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    chars = forms.join(found.select("form"), "form", "left_anti").where(~F.col("form").rlike("[\x80-\x9f�]")).select("n", F.explode(F.array_distinct(F.split(F.regexp_replace("form", r"[\x00-\x7F]", ""), ""))).alias("c"))
    alphabet = frozenset(r.c for r in chars.groupBy("c").agg(F.sum("n").alias("n")).where(F.col("n") >= max(3, total * 2e-6)).collect())
    rest = forms.join(found.select("form"), "form", "left_anti").select("form").mapInPandas(_unexplained(chains, alphabet), "form string, clean string, chain int")
    return materialize(found.unionByName(rest), "garbled")


def _with_garbled(picks: DataFrame, garbled: DataFrame, quoted: bool = False) -> DataFrame:
    """(doc_id, digest, form, clean) of each document's garbled forms; on demand with those quoted in documents that have others.

    Forms join forms, whatever their number: garbled ones are never the frequent ones, and hot forms are split by AQE.
    """
    hits = picks.where("form <> ''").join(garbled, "form")
    open_ = hits.where("not quoted")
    if not quoted:
        return open_
    spoilt = open_.select("doc_id", "digest").distinct()
    return hits.join(spoilt, ["doc_id", "digest"], "left_semi")


def garbled_documents(documents: DataFrame, **options) -> DataFrame:
    """(doc_id) of texts that were garbled in whole or in part.

    Null, empty and plain ASCII texts never are; a sequence quoted by itself as an example doesn't count. Repeated rows
    come out once. No rows in: no rows out.
    """
    picks = picked(documents)
    return _with_garbled(picks, garbled_forms(picks, **options)).select("doc_id").distinct()


def _restored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for doc, text, pairs in zip(b["doc_id"], b["text"], b["pairs"], strict=True):
            known = {p["form"]: p["clean"] for p in pairs}
            left = 0

            def new(m: re.Match) -> str:
                return whole(m.group())

            def whole(run: str) -> str:
                nonlocal left
                digits = re.findall("[0-9]+", run)
                shape = re.sub("[0-9]+", "0", run)
                if shape in known:
                    clean = known[shape]
                    if clean is not None and clean.count("0") == len(digits):
                        it = iter(digits)
                        return re.sub("0", lambda _: next(it), clean)
                if "\xa0" in run:
                    return "\xa0".join(map(whole, run.split("\xa0")))
                core = _around.sub("", run)
                if core != run and core:
                    at = run.index(core)
                    return run[:at] + whole(core) + run[at + len(core) :]
                left += shape in known
                return run

            restored = _form.sub(new, text)
            out.append((doc, restored, left))
        yield pd.DataFrame(out, columns=["doc_id", "restored", "left"])


def restored_documents(documents: DataFrame, **options) -> DataFrame:
    """(doc_id, restored, left) of garbled texts: the text with every garbled form that has a known original put
    right, those in quotes too, as the text isn't sound, and the number of those left as they were."""
    picks = picked(documents)
    pairs = _with_garbled(picks, garbled_forms(picks, **options), quoted=True).select("doc_id", "digest", "form", "clean").groupBy("doc_id", "digest").agg(F.collect_set(F.struct("form", "clean")).alias("pairs"))
    texts = documents.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text").join(pairs, ["doc_id", "digest"])
    return texts.select("doc_id", "text", "pairs").mapInPandas(_restored, "doc_id long, restored string, left long")


#: Ways in which ``planted`` garbles: what is common for Latin and for Cyrillic texts.
PLANTED = {"latin": [("utf-8", "cp1252"), ("utf-8", "iso8859-1"), ("cp1252", "mac-roman"), ("utf-8", "cp1250")], "cyrillic": [("utf-8", "cp1251"), ("cp1251", "koi8-r"), ("utf-8", "cp1252"), ("cp866", "cp1251")]}


def _planted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for doc, text in zip(b["doc_id"], b["text"], strict=True):
            kinds = PLANTED["cyrillic" if sum("\u0400" <= c <= "\u04ff" for c in text) > len(text) / 4 else "latin"]
            pair = kinds[doc % len(kinds)]
            # What the encoding lacks was written otherwise before.
            plain = text if pair[0] == "utf-8" else "".join(c if _encode(c, pair[0]) is not None else "?" for c in text)
            g = garble(plain, (pair,))
            if g and g != plain:
                out.append((-1 - doc, plain, g))
        yield pd.DataFrame(out, columns=["doc_id", "text", "garbled"])


def planted(documents: DataFrame) -> DataFrame:
    """(doc_id, text, garbled): texts and what a wrong encoding makes of them, under new ids (-1 - doc_id)."""
    return documents.select("doc_id", "text").mapInPandas(_planted, "doc_id long, text string, garbled string")
