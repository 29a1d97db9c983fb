"""Secret scans: candidates judged by a random forest, in DataFrame operations only."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.llm.common import WHITE_SPACE_RUN, text_or_empty

MARKER = "[SECRET]"
TREES, DEPTH, SEED = 24, 6, 7
#: Labelled findings that the default forest is trained on.
FINDINGS = 6000
#: Made-up words drawn for each of them.
NAMES = 64
#: A finding is a secret if more than this share of the trees says so.
MAJORITY = 0.5

#: Words beside a secret, words beside what only looks like one, and words that names are made of.
SECRET_WORDS = "token secret password passwd pwd apikey api_key api-key access_key auth bearer credential private_key client_secret".split()
PLAIN_WORDS = "sha sha1 sha256 md5 hash commit checksum digest etag uuid guid revision version image file path url href class session order invoice".split()
DICTIONARY = (
    "about account action add address after all and api app application are array auth background base bin block body build button cache call case "
    "change check class client code color com config content control count create current data date default delete dev dir document down edit end error "
    "event example false field file filter first folder font for form from function get global group header height help here home host html http icon "
    "image import index info input insert item java key label last lib line link list load local log login main manager map max menu message method min "
    "model module name net new next node not null number object open option order org output package page param parent password path pixel place plugin "
    "point port position post print private process profile project public query read record remove report request reset resource response result "
    "return role root row run save schema screen script search select server service session set setting shared size sort source start state static "
    "status string style sub system tab table tag target temp test text the this time title token tool top total tree true type update url user util "
    "value version view web width window with work write your"
).split()

#: What look-alike words that are in no list are made of.
SYLLABLES = "ba co di fu ga he ji ko lu ma ne po qui ra sto tre vu wo xen zy".split()

#: A candidate's characters; a word with this many in a row and a digit among them, or any eight after a telling assignment, is looked at.
#: Tokens of a known form that holds dots are one candidate, with their dots.
_HOOK = r"hooks\.slack\.com/services/[A-Za-z0-9_/\-]{8,}|discord(?:app)?\.com/api/webhooks/[0-9]+/[A-Za-z0-9_\-]{8,}|[a-z0-9\-]+\.webhook\.office\.com/[A-Za-z0-9_/@\-]{8,}"
_DOTTED = r"eyJ[A-Za-z0-9_\-]{8,}(?:\.[A-Za-z0-9_\-]{4,}){1,2}|SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}|" + _HOOK
_CORE = _DOTTED + r"|[A-Za-z0-9_+/\-]{8,}={0,2}"
_LONG = r"[A-Za-z0-9_+/\-]{16}"
_TELLING = "(" + "|".join(SECRET_WORDS) + "|pass(?![a-z]))"
_PLAIN = r"(^|[^a-z])(" + "|".join(PLAIN_WORDS) + r")([^a-z]|$)"
#: How keys of known issuers begin; the last form is the body of a private key block.
_KNOWN = "|".join(
    (
        r"^(AKIA|ASIA)[A-Z0-9]{16}$",
        r"^gh[pousr]_[A-Za-z0-9]{36}",
        r"^github_pat_[A-Za-z0-9_]{22}",
        r"^glpat-[A-Za-z0-9_\-]{20}",
        r"^sk-(proj-|ant-[a-z0-9]+-)?[A-Za-z0-9]{20}",
        r"^[rs]k_(live|test)_[A-Za-z0-9]{16}",
        r"^xox[abprs]-",
        r"^xapp-[0-9]",
        r"^AIza[A-Za-z0-9_\-]{35}$",
        r"^npm_[A-Za-z0-9]{36}",
        r"^pypi-[A-Za-z0-9_\-]{32}",
        r"^hf_[A-Za-z0-9]{30}",
        r"^shp(at|ca|pa|ss)_[0-9a-fA-F]{32}",
        r"^do[opr]_v1_[0-9a-f]{32}",
        r"^eyJ[A-Za-z0-9_\-]{10}",
        r"^SG\.",
        r"^(hooks\.slack|discord|discordapp)\.com/",
        r"^[a-z0-9\-]+\.webhook\.office\.com/",
        r"^(\\[nr]|\s)+([A-Z][A-Za-z\-]*: .*\s+)*[A-Za-z0-9+/]{40}",
    )
)
_UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"

#: Inside a word: what ends a field, the last assignment with its name, and a name being assigned. A port's colon ends no field.
_FIELD_END = r"(?:[,;&?=@{}()<>\[\]|]|:(?!//))"
_ASSIGNMENT = r"[^,;&})>|\]]*[:=][^:=]*$"
_TOLD = _TELLING + r"[\w\-]*[\"'`]?\s*[=:]"

#: Values with symbols: what follows a telling assignment, in quotes or up to a separator or closing punctuation, and the password of a URL.
_CLOSING = r"[.:)\]}]"
_VALUE = (
    r"((?<=[\"'`])[^\s\"'`]++(?=[\"'`])|(?<![\"'`])(?:[^\s\"'`,;&<>.:)\]}]++|&(?![\w.\-]{1,64}=)|"
    + _CLOSING + r"(?!" + _CLOSING + r"{0,4}+(?:$|[\s\"'`,;<>])))++)"
)
_TOLD_VALUE = r"(?i)" + _TELLING + r"[\w\-]{0,64}[\"'`]?[=:]{1,2}[\"'`]?" + _VALUE
_FIRST_VALUE = r"^()[\"'`]?" + _VALUE
_URL_VALUE = r"(://)[^\s/@:\"'`]{0,64}:([^\s/@\"'`]{4,}+)(?=@)"
_SYMBOL = r"[^A-Za-z0-9_+/\-=]"
#: A word with one of these is looked at for such values.
_SYMBOLIC = r"[!@#$%^&*~?|(){}\[\]\\]"
_USERINFO = r"://[^\s/@:\"'`]{0,64}:\s*$"
#: What stands for a value and isn't one: calls, references, placeholders, templates.
_CODE = r"^[$%<{(\[]+[A-Za-z_({<]|[A-Za-z_]\(|->|::|\]$|^[A-Za-z_]+(\.[A-Za-z_]+)+|^[\w.+\-]+@[\w\-]+\.|^\*+$|^(.)\2*$"
#: A private key block: head, body, foot. Quantifiers are possessive, so that a block of any length takes no stack.
_PEM_HEAD, _PEM_FOOT = (r"-----" + end + r" (?:[A-Z0-9]+ ){0,4}PRIVATE KEY(?: BLOCK)?-----" for end in ("BEGIN", "END"))
_PEM = "(" + _PEM_HEAD + r")((?:[^\-]++|-{1,4}(?!-))*+)(" + _PEM_FOOT + ")"
#: Characters before a candidate inside its word that are read as its neighbourhood.
NEARBY = 256

FEATURES = ("length", "turns", "digits", "vowels", "distinct", "hex", "cases", "dictionary", "path", "telling", "plain", "assigned", "quoted", "known", "uuid", "symbols", "code", "userinfo")


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0)).cast("double")


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def features(core: Column, word: Column, left: Column, right: Column, before: Column | None = None) -> list[Column]:
    """FEATURES of a candidate: ``core`` inside ``word``, between neighbouring words ``left`` and ``right``; ``before`` is the text
    before it, by default ``left`` and the word's start."""
    n, lower = F.length(core), F.lower(core)
    before = F.lower(F.concat_ws(" ", left, F.substring(word, F.lit(1), F.position(core, word) - 1)) if before is None else before)
    spelled = F.regexp_replace(lower, "(" + "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))) + ")", "")

    def count(pattern: str, of: Column = core) -> Column:
        return n - F.length(F.regexp_replace(of, pattern, ""))

    values = (
        n.cast("double"),
        _share(F.size(F.regexp_extract_all(core, F.lit(r"[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+"), F.lit(0))) - 1, n),
        _share(count("[0-9]"), n),
        _share(count("[aeiou]", lower), n),
        _share(F.size(F.array_distinct(F.split(core, ""))), n),
        _flag(core.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        _flag(core.rlike("[a-z]") & core.rlike("[A-Z]")),
        _share(n - F.length(spelled), n),
        _share(count("[/.]", F.regexp_replace(word, r"^[^A-Za-z0-9/]+", "")), n) + _flag(word.rlike(r"://|^\.?\.?/|\.[a-z]{2,4}$")),
        _flag(before.rlike(_TELLING)),
        _flag(before.rlike(_PLAIN) | F.lower(right).rlike(_PLAIN)),
        _flag(before.rlike(r"[=:]\s*[\"'`]?$")),
        _flag(word.rlike(r"[\"'`]")),
        _flag(core.rlike(_KNOWN)),
        _flag(core.rlike(_UUID)),
        _share(count(_SYMBOL), n),
        _flag(core.rlike(_CODE)),
        _flag(before.rlike(_USERINFO)),
    )
    return [v.alias(name) for name, v in zip(FEATURES, values)]


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _inside(x: Column) -> Column:
    """Array of (at, nth, core, word, right, before): the candidates of one word, each with the text that is around it in the word.

    A word of a single core is looked at as a whole; of several, those that are long and near a digit, of a known form, or told.
    Cores and the pieces between them are addressed by number, so that a word of very many cores takes linear time.
    """
    pieces, cores, m = x["pieces"], x["cores"], F.size(x["cores"])

    def some(array: Column, k: Column) -> Column:
        return F.when((k >= 0) & (k < F.size(array)), F.get(array, k)).otherwise(F.lit(""))

    def ahead(k: Column) -> Column:
        near = F.concat(some(pieces, k - 2), some(cores, k - 2), some(pieces, k - 1), some(cores, k - 1), some(pieces, k))
        return F.substring(near, -NEARBY, NEARBY)

    def kept(c: Column) -> Column:
        k, core = c["k"], c["core"]
        digit = F.concat(some(pieces, k), core, some(pieces, k + 1)).rlike("[0-9]")
        told = F.lower(F.when(k <= 2, F.concat_ws(" ", x["told"], c["ahead"])).otherwise(c["ahead"])).rlike(_TOLD)
        return (m == 1) | (core.rlike(_LONG) & digit) | core.rlike(_KNOWN) | told

    def described(c: Column) -> Column:
        k, core = c["k"], c["core"]
        assigned = F.regexp_extract(c["ahead"], _ASSIGNMENT, 0)
        own = F.when(assigned == "", c["ahead"]).otherwise(assigned)
        whole = (k == 0) | (k <= 2) & (F.length(own) == F.length(c["ahead"]))
        port = core.rlike("^[0-9]{1,5}/")
        start = F.when(port, c["ahead"]).otherwise(F.regexp_replace(c["ahead"], "(?s)^.*" + _FIELD_END, ""))
        end = F.regexp_replace(some(pieces, k + 1), "(?s)" + _FIELD_END + ".*$", "")
        after = F.regexp_extract(F.concat(some(pieces, k + 1), some(cores, k + 1)), r"^[^,;&})>|\]@]*", 0)
        return F.struct(
            x["at"].alias("at"),
            k.alias("nth"),
            core.alias("core"),
            F.concat(start, core, end).alias("word"),
            F.when(k == m - 1, x["right"]).otherwise(after).alias("right"),
            F.when(whole, F.concat_ws(" ", x["left"], own)).otherwise(own).alias("before"),
        )

    each = F.transform(F.sequence(F.lit(0), m - 1), lambda k: F.struct(k.alias("k"), F.get(cores, k).alias("core"), ahead(k).alias("ahead")))
    return F.transform(F.filter(each, kept), described)


def _values(x: Column) -> Column:
    """Array of (at, nth, core, word, right, before): the values with symbols of one word, and the passwords of its URLs, numbered from -1 down."""
    w = x["word"]

    def found(pattern: str, last: int) -> Column:
        whole, value = (F.regexp_extract_all(w, F.lit(pattern), F.lit(group)) for group in (0, last))
        return F.transform(value, lambda v, k: F.struct(v.alias("core"), F.substring(F.get(whole, k), F.lit(1), F.length(F.get(whole, k)) - F.length(v)).alias("ahead")))

    first = F.when(F.lower(x["told"]).rlike(_TOLD + r"\s*$"), found(_FIRST_VALUE, 2))
    told = F.concat(F.coalesce(first, F.array().cast("array<struct<core:string,ahead:string>>")), found(_TOLD_VALUE, 2))
    told = F.filter(told, lambda v: (F.length(v["core"]) >= 6) & v["core"].rlike(_SYMBOL) & v["core"].rlike("[A-Za-z0-9]") & ~v["core"].rlike("://") & ~v["core"].rlike("^(" + _DOTTED + ")$"))
    every = F.concat(told, F.when(w.contains("://"), found(_URL_VALUE, 2)).otherwise(F.array().cast("array<struct<core:string,ahead:string>>")))
    return F.transform(
        every,
        lambda v, k: F.struct(
            x["at"].alias("at"), (-1 - k).alias("nth"), v["core"].alias("core"), v["core"].alias("word"), x["right"].alias("right"), F.concat_ws(" ", x["left"], v["ahead"]).alias("before")
        ),
    )


def _described(x: Column) -> Column:
    return F.struct(x["at"].alias("at"), x["nth"].alias("nth"), x["core"].alias("core"), *features(x["core"], x["word"], F.lit(""), x["right"], x["before"]))


def _key_blocks(text: Column) -> Column:
    """Array of (head, body, foot, ahead): the private key blocks of a text, each with the text between it and the one before."""
    ahead = F.split(text, _PEM)
    parts = [F.regexp_extract_all(text, F.lit(_PEM), F.lit(group)) for group in (1, 2, 3)]
    return F.zip_with(parts[0], F.arrays_zip(F.slice(ahead, F.lit(1), F.size(parts[0])).alias("ahead"), parts[1].alias("body"), parts[2].alias("foot")), lambda h, r: F.struct(h.alias("head"), r["body"].alias("body"), r["foot"].alias("foot"), r["ahead"].alias("ahead")))


def _with_bodies(text: Column, body: Callable[[Column], Column]) -> Column:
    """``text`` with ``body`` of the body of every private key block in place of the body."""

    def of(blocks: Column) -> Column:
        each = F.transform(blocks, lambda b: F.concat(b["ahead"], b["head"], body(b["body"]), b["foot"]))
        return F.concat(F.array_join(each, ""), F.element_at(F.split(text, _PEM), -1))

    return F.when(text.rlike(_PEM), _let(_key_blocks(text), of)).otherwise(text)


def _bodies(text: Column) -> Column:
    """Array of one array: the bodies of private key blocks as candidates, at the word where each begins."""

    def of(blocks: Column) -> Column:
        def gaps(s: Column) -> Column:
            return F.size(F.split(s, WHITE_SPACE_RUN)) - 1

        counts = F.transform(blocks, lambda b: F.struct(gaps(F.concat(b["ahead"], b["head"])).alias("ahead"), gaps(F.concat(b["body"], b["foot"])).alias("own")))

        def each(c: Column) -> Column:
            def one(b: Column, k: Column) -> Column:
                before = F.aggregate(F.slice(c, F.lit(1), k), F.lit(0), lambda t, n: t + n["ahead"] + n["own"])
                at = before + F.get(c, k)["ahead"] + F.when(b["body"].rlike(r"^[\x20\x09-\x0D]"), F.lit(1)).otherwise(F.lit(0))
                return _described(F.struct(at.alias("at"), F.lit(-1).alias("nth"), b["body"].alias("core"), F.lit("").alias("word"), F.lit("").alias("right"), F.lower(b["head"]).alias("before")))

            return F.transform(blocks, one)

        return F.array(_let(counts, each))

    return F.when(text.rlike(_PEM), _let(_key_blocks(text), of))


def _by_word(text: Column) -> Column:
    """Array of arrays of (at, nth, core, features...): what might be a secret in a whole text, word by word."""
    # bodies of private keys are candidates by themselves and hold no others
    words = F.split(_with_bodies(text, lambda body: F.regexp_replace(body, r"[^\x20\x09-\x0D]", ".")), WHITE_SPACE_RUN)

    def of(ws: Column) -> Column:
        def near(i: Column, d: int) -> Column:
            return F.coalesce(F.get(ws, i + d), F.lit(""))

        def left(i: Column) -> Column:
            return F.concat_ws(" ", near(i, -3), near(i, -2), near(i, -1))

        def valued(w: Column) -> Column:
            return w.rlike(_SYMBOLIC)

        def looks(i: Column) -> Column:
            w = F.get(ws, i)
            told = F.lower(F.concat_ws(" ", near(i, -2), near(i, -1), w)).rlike(_TOLD)
            return (w.rlike(_LONG) & w.rlike("[0-9]")) | (w.contains("://") & w.rlike(_URL_VALUE)) | ((w.rlike(_CORE) | valued(w)) & told)

        at = F.filter(F.sequence(F.lit(0), F.size(ws) - 1), looks)

        def described(i: Column) -> Column:
            w = F.get(ws, i)
            cores, pieces = F.regexp_extract_all(w, F.lit(_CORE), F.lit(0)), F.split(w, _CORE)
            told = F.concat_ws(" ", near(i, -2), near(i, -1))
            word = F.struct(i.alias("at"), w.alias("word"), pieces.alias("pieces"), cores.alias("cores"), told.alias("told"), left(i).alias("left"), near(i, 1).alias("right"))

            def both(x: Column) -> Column:
                inside = F.when(F.size(x["cores"]) > 0, F.filter(_inside(x), lambda c: ~c["core"].rlike("^[0-9]{1,15}$")))
                none = F.array().cast("array<struct<at:int,nth:int,core:string,word:string,right:string,before:string>>")
                values = F.when(valued(x["word"]), _values(x))
                return F.transform(F.concat(F.coalesce(values, none), F.coalesce(inside, none)), _described)

            return _let(word, both)

        return F.transform(at, described)

    # texts without a digit, a URL or an assignment of a telling word can hold no candidate
    possible = text.rlike("[0-9]") | text.contains("://") | F.lower(text).rlike(_TOLD)
    none = F.array().cast(_BY_WORD)
    return F.concat(F.coalesce(_bodies(text), none), F.coalesce(F.when(possible, _let(words, of)), none))


_BY_WORD = "array<array<struct<at:int,nth:int,core:string," + ",".join(f"`{name}`:double" for name in FEATURES) + ">>>"


def candidates(text: Column) -> Column:
    """Array of (at, nth, core, features...): what might be a secret in a whole text; ``at`` counts words from 0, ``nth`` the cores inside the
    word. Values with symbols, passwords of URLs and bodies of private key blocks (at the word where each begins) have numbers below 0."""
    return F.flatten(_by_word(text))


def labelled_findings(spark: SparkSession, count: int = FINDINGS) -> DataFrame:
    """Synthetic labelled findings (core, word, left, right, label), made by a fixed rule from SHA-256 digests of row numbers.

    Secrets are random hexadecimal, base64 or prefixed keys, passwords with symbols or in URLs, webhooks and bodies of private keys, most of
    those without a form of their own beside a telling word. The others are what scanners report wrongly:
    commit and checksum digests, UUIDs, paths, identifiers made of words, long numbers, placeholders, words of a running text, calls and
    references beside a telling word, encoded data, URLs; a third of the words in them are made of syllables, so that they are in no list.
    """
    rows = spark.range(count).select("id", F.sha2(F.concat(F.lit("finding "), F.col("id").cast("string")), 256).alias("h"))
    draw = F.pmod(F.xxhash64("id"), F.lit(1000))
    mixed = F.regexp_replace(F.base64(F.unhex(F.col("h"))), "[+/=]", "x")
    pick = lambda words, salt: F.element_at(F.lit(list(words)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(words))) + 1).cast("int"))
    drawn = lambda words, salt: F.get(F.lit(list(words)), F.pmod(F.xxhash64(F.col("id"), salt), F.lit(len(words))).cast("int"))
    syllables = lambda s: F.concat(*(drawn(SYLLABLES, 100 * s + k) for k in range(3)))
    unlisted = lambda s: F.pmod(F.xxhash64(F.col("id"), 1000 + s), F.lit(3)) == 0
    # arrays made by functions over elements: as plain columns they would be more code than a Java method holds
    rows = rows.withColumn("made", F.transform(F.sequence(F.lit(0), F.lit(NAMES)), syllables))
    rows = rows.withColumn("names", F.transform("made", lambda m, s: F.when(unlisted(s), m).otherwise(drawn(DICTIONARY, s))))
    made, name = (lambda salt: F.get("made", F.lit(salt))), (lambda salt: F.get("names", F.lit(salt)))
    kind = F.pmod(F.col("id"), F.lit(26)).cast("int")
    signs = lambda salt: pick(tuple("!@#$%^&*~?|.("), salt)
    several = F.concat_ws("_", name(1), name(2), name(3), F.substring("h", 1, 2))
    core = F.element_at(
        F.array(
            F.substring("h", 1, 40),
            F.substring(mixed, 1, 40),
            F.concat(F.lit("AKIA"), F.upper(F.substring("h", 1, 16))),
            F.concat(F.lit("ghp_"), F.substring(mixed, 1, 36)),
            F.substring("h", 1, 32),
            F.concat(F.substring(mixed, 1, 12), F.lit("-"), F.substring(mixed, 14, 12)),
            F.substring("h", 1, 40),
            F.substring("h", 1, 32),
            F.concat_ws("-", F.substring("h", 1, 8), F.substring("h", 9, 4), F.substring("h", 13, 4), F.substring("h", 17, 4), F.substring("h", 21, 12)),
            F.concat_ws("/", name(4), name(5), F.concat(name(6), F.substring("h", 1, 4))),
            several,
            F.translate(F.substring("h", 1, 16), "abcdef", "012345"),
            F.concat(F.lit("your_"), pick(("api_key", "token", "secret"), 7), F.lit("_here"), F.repeat(F.lit("x"), F.lit(6)), F.lit("1")),
            F.concat(name(8), name(9), name(10), F.lit("2")),
            F.concat_ws(".", F.concat(F.lit("eyJ"), F.substring(mixed, 1, 20)), F.concat(F.lit("eyJ"), F.substring(mixed, 5, 30)), F.substring(mixed, 2, 40)),
            F.initcap(F.concat(made(21), made(22), F.lit("7"))),
            F.substring(mixed, 1, F.pmod(F.xxhash64("id", F.lit(30)), F.lit(16)).cast("int") + 8),
            F.concat(F.substring(mixed, 1, 3), signs(31), F.substring(mixed, 5, F.pmod(F.xxhash64("id", F.lit(33)), F.lit(8)).cast("int") + 2), signs(32), F.substring(mixed, 20, 3)),
            F.concat(F.lit("hooks.slack.com/services/T"), F.upper(F.substring("h", 1, 9)), F.lit("/B"), F.upper(F.substring("h", 10, 9)), F.lit("/"), F.substring(mixed, 1, 24)),
            F.concat(pick(("sk_live_", "rk_live_", "sk_test_", "glpat-", "npm_", "hf_", "sk-", "xoxb-"), 34), F.substring(mixed, 1, 36)),
            F.concat(pick(("\n", "\r\n", "\\n"), 35), F.lit("MII"), F.repeat(F.concat(mixed, F.lit("\n")), F.lit(5))),
            F.concat(signs(31), F.substring(mixed, 5, F.pmod(F.xxhash64("id", F.lit(33)), F.lit(8)).cast("int") + 6), signs(32), F.substring("h", 1, 1)),
            F.element_at(F.array(F.concat(F.lit("${"), name(41), F.lit("}")), F.concat(name(42), F.lit("_"), name(43), F.lit("(")), F.concat_ws(".", name(44), name(45), name(46)), F.concat(F.lit("<"), name(47), F.lit("-"), name(48)), F.lit("*" * 8), F.lit("[SECRET"), F.concat(name(49), F.lit("@"), name(50), F.lit(".example"))), F.pmod(F.xxhash64("id", F.lit(36)), F.lit(7)).cast("int") + 1),
            F.concat(mixed, F.substring(mixed, 2, 20)),
            F.concat_ws("/", F.lit("com"), name(51), F.substring("h", 1, 8), F.concat(name(52), F.substring("h", 9, 6))),
            F.element_at(F.array(F.concat(name(53), F.lit("?")), F.concat(name(54), F.lit("!")), F.concat(name(55), F.lit("|"), name(56)), F.concat(name(57), F.lit("/"), name(58), F.lit("."))), F.pmod(F.xxhash64("id", F.lit(37)), F.lit(4)).cast("int") + 1),
        ),
        kind + 1,
    )
    secret = (kind < 6) | (kind == 14) | kind.between(16, 21)
    spoken = pick(("the", "and", "of", "then", "with", "see"), 11)
    told = F.concat(pick(SECRET_WORDS, 12), pick((" =", ":", " :", "="), 13))
    plain = F.concat(pick(PLAIN_WORDS, 14), pick((" ", ":", " =", ""), 15))
    # a few secrets stand alone if their own form tells, a few harmless words stand beside a telling one
    url = F.concat(pick(("postgres", "https", "amqp", "redis", "mongodb"), 60), F.lit("://"), F.when(draw < 200, F.lit("")).otherwise(name(61)), F.lit(":"))
    left = F.when(kind == 16, url).when(kind == 20, F.lit("-----begin private key-----")).when(kind.isin(18, 19), F.when(draw < 300, told).otherwise(spoken)).when(kind.isin(22, 25), told).when(secret, F.when((draw < 930) | kind.isin(0, 1, 4, 5, 17, 21), told).otherwise(spoken)).otherwise(
        F.when(kind.isin(6, 7), F.when(draw < 700, plain).otherwise(spoken)).when((kind == 12) | (draw < 150) & kind.isin(9, 10, 11, 13, 15), told).otherwise(F.when(draw < 500, plain).otherwise(spoken))
    )
    quote = F.when(F.pmod(F.xxhash64("id", F.lit(16)), F.lit(2)) == 0, F.lit('"')).otherwise(F.lit(""))
    word = F.concat(quote, F.when(kind == 9, F.lit("/")).when(kind.isin(18, 24), F.lit("https://")).otherwise(F.lit("")), core, quote)
    word = F.when(kind.isin(16, 17, 21, 22, 25), core).when(kind == 20, F.lit("")).otherwise(word)  # as candidates of these kinds are described
    return rows.select(core.alias("core"), word.alias("word"), F.concat(spoken, F.lit(" "), left).alias("left"), spoken.alias("right"), secret.cast("double").alias("label"))


def train(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> RandomForestClassificationModel:
    """A forest from labelled findings (core, word, left, right, label 0 or 1)."""
    rows = labelled.select(*features(F.col("core"), F.col("word"), F.col("left"), F.col("right")), "label")
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(vectors.select("features", "label"))


_LINE = re.compile(r"^(\s*)(?:(If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)|Predict: ([\d.]+))$")


def as_votes(model: RandomForestClassificationModel) -> Callable[[Column], Column]:
    """The share of trees that vote for a secret, as a column over a struct of the features."""

    def node(lines: list[re.Match], x: Column) -> Column:
        m = lines.pop(0)
        if m[6]:
            return F.lit(float(m[6]))
        yes = node(lines, x)
        lines.pop(0)  # the Else of this If
        return F.when(x[FEATURES[int(m[3])]] <= float(m[5]), yes).otherwise(node(lines, x))

    trees = [[m for m in map(_LINE.match, tree.toDebugString.splitlines()) if m] for tree in model.trees]

    def votes(x: Column) -> Column:
        total = F.lit(0.0)
        for lines in trees:
            total = total + node(list(lines), x)
        return total / len(trees)

    return votes


def _secrets(text: Column, model: RandomForestClassificationModel, majority: float) -> Column:
    """Array of (at, nth, core, score) of the candidates of a text that the forest takes for secrets."""
    votes = as_votes(model)

    def scored(x: Column) -> Column:
        return F.struct(x["at"].alias("at"), x["nth"].alias("nth"), x["core"].alias("core"), votes(x).alias("score"))

    def of(found: Column) -> Column:
        # parts of a value that is one itself aren't told again
        return F.filter(found, lambda x: (x["nth"] < 0) | ~F.exists(found, lambda v: (v["nth"] < 0) & v["core"].contains(x["core"])))

    def told(xs: Column) -> Column:
        return _let(F.filter(F.transform(xs, scored), lambda x: x["score"] > majority), of)

    return F.flatten(F.transform(_by_word(text_or_empty(text)), told))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: RandomForestClassificationModel | None = None, majority: float = MAJORITY) -> DataFrame:
    """One row per secret found: (doc_id, word, nth, length, secret_sha256, score); the secret itself isn't shown.

    word counts from 0, and so does nth, the number of the secret among the word's runs of eight or more key characters. Values with
    symbols, passwords of URLs and bodies of private key blocks have numbers from -1 down; of what they hold no more is told.

    Every whole text is read in place: no join, no shuffle. Null and empty texts, and texts without a secret, give no
    row. Repeated rows each give theirs. Null ids are kept. An empty table gives an empty result. Extra columns are not read.
    """
    model = model or train(labelled_findings(docs.sparkSession))
    found = docs.select(docs[id_col].alias("doc_id"), F.explode(_secrets(docs[text_col], model, majority)).alias("s"))
    return found.select("doc_id", F.col("s.at").alias("word"), F.col("s.nth").alias("nth"), F.length("s.core").alias("length"), F.sha2("s.core", 256).alias("secret_sha256"), F.col("s.score").alias("score"))


def _without(text: Column, secrets: Column, marker: str, values: Column | None = None) -> Column:
    """``text`` with every candidate, whole, that equals one of ``secrets`` replaced by ``marker``, and each of ``values`` that no letter or
    digit continues; what merely holds a secret stays."""
    text = _with_bodies(text, lambda body: F.when(F.array_contains(secrets, body), F.lit(marker)).otherwise(body))
    words, gaps = F.split(text, WHITE_SPACE_RUN), F.regexp_extract_all(text, F.lit(WHITE_SPACE_RUN), F.lit(0))

    def without_value(word: Column, value: Column) -> Column:
        quoted = F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![A-Za-z0-9])"))
        return F.when(word.contains(value), F.regexp_replace(word, quoted, F.lit(re.sub(r"([\\$])", r"\\\1", marker)))).otherwise(word)

    def replaced(word: Column) -> Column:
        return by_core(word) if values is None else _let(F.reduce(values, word, without_value), by_core)

    def by_core(word: Column) -> Column:
        cores, pieces = F.regexp_extract_all(word, F.lit(_CORE), F.lit(0)), F.split(word, _CORE)

        def of(x: Column) -> Column:
            each = F.transform(x["cores"], lambda c, k: F.concat(F.get(x["pieces"], k), F.when(F.array_contains(secrets, c), F.lit(marker)).otherwise(c)))
            return F.concat(F.array_join(each, ""), F.element_at(x["pieces"], -1))

        return F.when(word.rlike(_CORE), _let(F.struct(cores.alias("cores"), pieces.alias("pieces")), of)).otherwise(word)

    def joined(x: Column) -> Column:
        return F.array_join(F.transform(x["words"], lambda w, k: F.concat(replaced(w), F.coalesce(F.get(x["gaps"], k), F.lit("")))), "")

    return _let(F.struct(words.alias("words"), gaps.alias("gaps")), joined)


def redact(docs: DataFrame, text_col: str = "text", model: RandomForestClassificationModel | None = None, majority: float = MAJORITY, marker: str = MARKER, count_col: str | None = None) -> DataFrame:
    """``docs`` with every secret found in its text replaced by ``marker``, and ``count_col``, if there is one, counted again where that changed a text.

    A secret that is found at one place goes wherever it stands whole in the text; longer runs of key characters that hold it stay. Rows, other
    columns and null texts stay as they are, whatever the columns' names.
    """
    model = model or train(labelled_findings(docs.sparkSession))
    told = F.transform(_secrets(docs[text_col], model, majority), lambda s: F.struct(s["core"].alias("core"), ((s["nth"] < 0) & ~s["core"].rlike(r"[\x20\x09-\x0D]")).alias("value")))
    found = docs.select(F.struct("*").alias("row"), F.array_distinct(told).alias("cores"))
    text, changed = F.col("row")[text_col], F.size("cores") > 0
    cores = F.transform("cores", lambda s: s["core"])
    values = F.transform(F.filter("cores", lambda s: s["value"]), lambda s: s["core"])
    clean = found.select("row", "cores", F.when(changed, _without(text, cores, marker, values)).otherwise(text).alias("clean"))
    values = {c: F.col("row")[c] for c in docs.columns} | {text_col: F.col("clean")}
    if count_col:
        values[count_col] = F.when(changed, F.length("clean").cast(docs.schema[count_col].dataType)).otherwise(F.col("row")[count_col])
    return clean.select(*(v.alias(c) for c, v in values.items()))
