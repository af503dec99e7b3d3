"""What one piece of text tells about itself: its blocks and their figures, by which a model tells running language.

Everything here is plain Python over one string; the Spark side is in ``textstats``.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections.abc import Iterator

# Frequent words of some languages, in alphabetical order.
COMMON_WORDS = {
    "en": """a about after again all almost also although am an and another any are as at back be because been before
        being both but by can could did do does don't down each every few first for from get go had has have he her here
        him his how i if in instead into is it it's its just know like made many may me mean more most much my neither
        never no nor not nothing now of off often on once one only or other our out over please same she should since so
        some something still such than that the their them then there these they this those though through to too two
        under until up us very was we well were what when where whether which while who why will with without would
        yeah yes you your""",
    "de": """aber alle als am an auch auf aus bei bis da danach dann das dass dem den der des die dies diese dieser
        dort durch ein eine einem einen einer eines er es etwa für gibt gilt hat hier ich ihr im in ist ja jede kein
        keine mehr mich mit nach nicht noch nur oder ohne sehr sich sie sind so über um und uns unter vom von vor
        waren warum was wegen weil wenn werden wie wieder wir wird wurde wurden zu zum zur zwei""",
    "nl": """aan al alleen als bij daar daarna dan dat de deze die dit door een en er geen haar heb hebben heeft het
        hier hij hoe ik in is je kan maar me meer met mij mijn na naar naast niet nog of om omdat onder ook op over te
        tegen toch toen tot uit van veel voor waarom waren was wat we weer wel werd wij worden
        wordt zeer zich zij zijn zo zonder""",
    "es": """a al algo ante con como cuando de del desde después donde dos el ella en entre era es esta este esto
        está fue fueron ha han hasta la las le lo los luego más me mi mientras muy no nos nunca para pero poco
        por porque qué que se ser si sin sobre solo son su sus también tan todo todos tras un una unos y ya""",
    "fr": """au aux avec ce ces cette dans de des du elle en est et était il ils je la le les leur lui mais même ne nous on
        ou où par pas plus pour qu que qui sa sans se ses son sont sur tout un une vous y""",
    "ru": """а без был была были было в во вот все всего где для до его если есть ещё же за и из или их к как когда мы на
        над не нет но о около он она они от остаётся перед по под потому почему при с со так там то только у уже что
        это я""",
    "el": """αλλά από αυτό δεν δύο είναι ένα ή για και κατά με μέχρι μη μόνο να οι όταν ότι που προς σε στα στη στην στις
        στο στον τα τη την της τι τις το τον του τους των χωρίς ως γιατί μετά ξανά εκεί περίπου πριν είμαι ακόμη""",
}
COMMON = frozenset(w for words in COMMON_WORDS.values() for w in words.split())
# Words that call for a noun, and words that can't follow them directly.
_ARTICLES = frozenset("a an dem einem einen el every la las los my our some the their un una your".split())
_NO_FOLLOW = frozenset(
    """a an and are as at because been but by for from had has have he if in is it it's of on or our she that the their
    then they this to was we were when with you my i not don't your de del el en la las los los por que un una y se es
    een het op van voor in met en der die das dem den ein eine im am und ist wird mit auf für weil omdat maar naar""".split()
)
_ALLOWED = frozenset([("a", "la"), ("a", "las"), ("a", "los"), ("a", "un"), ("a", "una"), ("a", "el")])
_MARK = re.compile(r"<\|[^|<>]{0,40}\|>")
_QUOTE = re.compile(r"(?m)^\s*>[> ]*")
_SPEAKER = re.compile(r"(?m)^\s*[A-Z]\w{0,14}:\s")

_NEWLINE = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,300}>|&[a-z]{2,8};|&#\d{1,6};")
_END = re.compile(r"[.!?…:;。！？\"”»)]\W*$")
_BULLET = re.compile(r"^\s*(?:[-–—•*·▪◦+]\s|\(?\d{1,5}[.)]\s|#\d{1,5}\s|\[[ xX]?\]\s)")
_KANA = re.compile(r"[぀-ゟ]")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_INNER = re.compile(r"[^\W\d_][|/\\§°^_~;:,.@#*=+{}\[\]<>]+[^\W\d_]")
_STAMP = re.compile(r"^\W*\d{4}-\d\d-\d\d\b.*\b\d{1,2}:\d\d")
_CLOCKED = re.compile(r"\b0x[0-9a-fA-F]{4,}\b|\b[A-Z]{3,5}\b\s*\[\d+\]")
_VOWEL = re.compile(r"[aeiouyäöüáéíóúàèâêîôûαεηιουωάέήίόύώаеёиоуыэюяій]", re.I)
_SEPARATOR = re.compile(r"[,;/|•»·]|\s[-–=]\s|:\s|#\w")
_STOP = re.compile(r"[.!?。](?:\s|$)")
_COMMA = re.compile(r",\s")
_CASED = re.compile(r"[^.!?:;,\"“”«»()\-–—…'\n\r]\s+([A-Z][a-z]+)\b")
_LONGRUN = re.compile(r"[bcdfghjklmnpqrstvwxz]{5,}|^[bcdfghjklmnpqrstvwxz;]{3,}$", re.I)
_PIECE = 1200
CHUNK = 60_000
EDGE = 6_000


def pieces_of(line: str) -> list[str]:
    """Long lines in pieces of about a thousand characters, cut at white space where there is any."""
    out, at = [], 0
    while len(line) - at > _PIECE * 3 // 2:
        end = line.rfind(" ", at + _PIECE // 2, at + _PIECE)
        end = end if end > 0 else at + _PIECE
        out.append(line[at:end])
        at = end
    out.append(line[at:])
    return out


def structured(line: str) -> bool:
    """A row of a table, of machine output or of an enumeration, by its form alone."""
    s = _MARK.sub("", line).strip()
    words = _WORD.findall(s)
    if "\t" in s or s.count("|") >= 2 or s.count(";") >= 3 and len(words) < 4 * s.count(";"):
        return True
    if re.search(r"\S {3,}\S.*\S {2,}\S", s) and sum(c.isdigit() for c in s):
        return True
    if _STAMP.search(s) or len(_CLOCKED.findall(s)) >= 2 and len(words) < 12:
        return True
    if len(s) and sum(len(t) for t in _TAG.findall(s)) > 0.5 * len(s):
        return True
    return bool(re.match(r"^[\w./\\-]+\.\w{2,4}$", s)) and ("/" in s or "_" in s)


# What is told of a block, in this order.
FIGURES = (
    "letters", "digits", "cjk", "kana", "words", "size", "latin", "common", "different_words", "different_pairs", "different_letter_pairs",
    "word_length", "word_length_spread", "long_words", "long_tokens", "hard_words", "vowelless", "broken_words", "separators", "sentence_ends",
    "commas", "words_a_line", "bullets", "ended", "structured", "lines", "odd_followers", "odd_capitals", "short_common", "alternation", "odd_pairs",
)


@functools.lru_cache(1 << 16)
def _hard(word: str) -> tuple[bool, bool, bool, bool]:
    """Whether a word has a run of consonants without being common, is in Latin letters, is so without a vowel, is common."""
    latin = word[0] < "ɐ"
    return bool(_LONGRUN.search(word)) and word not in COMMON, latin, latin and not _VOWEL.search(word), word in COMMON


def figures(block: list[str], bulleted: bool, tabular: bool) -> list[float]:
    """The ``FIGURES`` of a block of lines, all of them ``bulleted`` and ``tabular`` or none; tags, quote marks and speakers' names are left out, as they stand in prose too."""
    text = "\n".join(block)
    bare = _SPEAKER.sub("", _QUOTE.sub("", _TAG.sub(" ", _MARK.sub(" ", text))))
    tokens = bare.split()
    dense = "".join(tokens)
    size, n_lines = max(1, len(dense)), len(block)
    words = [w.lower().replace("’", "'") for w in _WORD.findall(bare)]
    n, m = len(words), max(1, len(words))
    letters = list(filter(str.isalpha, dense))
    marks = 0 if dense.isascii() else sum(unicodedata.category(c)[0] == "M" for c in dense if not c.isascii())
    traits = [_hard(w) for w in words]
    common = [t[3] for t in traits]
    pairs = list(zip(words, words[1:]))
    articles = [b in _NO_FOLLOW and (a, b) not in _ALLOWED for a, b in pairs if a in _ARTICLES]
    length = [len(w) for w in words]
    mean = sum(length) / m
    return [
        (len(letters) + marks) / size,
        sum(map(str.isdigit, dense)) / size,
        len(_CJK.findall(bare)) / size,
        len(_KANA.findall(bare)) / size,
        math.log1p(n),
        math.log1p(len(dense)),
        sum(t[1] for t in traits) / m,
        sum(common) / m,
        len(set(words)) / min(m, 60),
        len(set(pairs)) / max(1, min(n - 1, 80)),
        len(set(zip(letters, letters[1:]))) / max(1, min(len(letters), 400)),
        mean,
        math.sqrt(sum((x - mean) ** 2 for x in length) / m),
        sum(x > 20 for x in length) / m,
        sum(len(x) > 25 for x in tokens) / max(1, len(tokens)),
        sum(t[0] for t in traits) / m,
        sum(t[2] for t in traits) / m,
        len(_INNER.findall(bare)) / m,
        len(_SEPARATOR.findall(bare)) / m,
        len(_STOP.findall(bare)) / m,
        len(_COMMA.findall(bare)) / m,
        n / n_lines,
        float(bulleted),
        sum(bool(_END.search(x)) for x in block) / n_lines,
        float(tabular),
        math.log1p(n_lines),
        sum(articles) / max(1, len(articles)),
        sum(w.lower() in COMMON and w != "I" for w in _CASED.findall(bare)) / m,
        sum(c for c, w in zip(common, words) if len(w) <= 4) / m,
        sum(a != b for a, b in zip(common, common[1:])) / m,
        sum(a in _NO_FOLLOW and b in _NO_FOLLOW for a, b in pairs) / m,
    ]


def split_points(text: str, size: int = CHUNK) -> list[tuple[int, int]]:
    """Chunk bounds: after the last line end of the last fifth, else after its last white space, else anywhere."""
    out, at = [], 0
    while len(text) - at > size:
        lo, hi = at + size - size // 5, at + size
        cut = text.rfind("\n", lo, hi) + 1 or text.rfind(" ", lo, hi) + 1 or hi
        out.append((at, cut))
        at = cut
    out.append((at, len(text)))
    return out


def units(text: str) -> Iterator[str]:
    """The lines of a text, long ones in pieces."""
    for line in _NEWLINE.split(text):
        if len(line) > _PIECE * 3 // 2:
            yield from pieces_of(line)
        else:
            yield line


def blocks(text: str, before: str = "") -> list[tuple[int, list[float] | None]]:
    """Size (characters that aren't white space) and figures of every block of a text; figures are None where a line comes for the third time or more.

    A block ends at an empty line, where lines change between enumeration, table and others, after about a
    thousand characters and where a chunk ends, so chunks give what the whole gives. ``text`` is in composed
    form; ``before`` holds what stands before it, of which the last two lines matter.
    """
    out: list[tuple[int, list[float] | None]] = []
    for a, b in split_points(text):
        back = text[max(0, a - EDGE) : a] if a else before
        out += _blocks(text[a:b], [x.strip() for x in list(units(back))[-3:]])
    return out


def _blocks(text: str, past: list[str]) -> list[tuple[int, list[float] | None]]:
    out: list[tuple[int, list[float] | None]] = []
    block: list[str] = []
    kind = (False, False)

    def close() -> None:
        if block:
            out.append((sum(len("".join(x.split())) for x in block), figures(block, *kind)))
            block.clear()

    # A chunk that begins at a line end has an empty line last among those before it.
    past = past[:-1] if past and not past[-1] else past
    last = past[-1] if past else None
    repeats = int(len(past) > 1 and past[-2] == last)
    for piece in units(text):
        bare = piece.strip()
        if not bare:
            close()
            last, repeats = None, 0
            continue
        repeats = repeats + 1 if bare == last else 0
        if repeats >= 2:
            close()
            out.append((len("".join(piece.split())), None))
        else:
            own = (bool(_BULLET.match(piece)), structured(piece))
            if own != kind:
                close()
                kind = own
            block.append(piece)
            if sum(map(len, block)) > _PIECE:
                close()
        last = bare
    close()
    return out
