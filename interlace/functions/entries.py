"""The grammar of a roster's entries: a name, then clauses of roles and organisations, as DataFrame expressions.

A page is a row. Its lines become entries, an entry a name and a body, and the body's clauses are folded
over an array: what is carried from one to the next are the roles that a bare clause inherits. So a page is
read without a shuffle, and the roster of any number of volumes is one scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from interlace.functions.registers import RANKS
from interlace.functions.rosters import BREAKABLE, is_firm, organisation, running_head
from interlace.functions.text import fold, name_key

# What is printed before a name; the shape of an entry's beginning; words that a name may hold in small
# letters, in an entry's first name and in the names after a comma; what marks a firm in the place of a name.
HONORIFIC = r"(?:S\.\s?E\.|S\.\s?A\.|LL\.\s?EE\.|Sir|Lord|Dr\.?|M\.|Mme|Mlle|Cav\.|Comm\.)"
ENTRY = rf"^({HONORIFIC}\s+)?([A-ZÀ-Þ][^,;]{{1,45}}?),\s+(?=\S)"
NAME_WORDS = "de du des la le el al van von di da bin ben abou abu d l".split()
GIVEN_WORDS = "me dr rt hon sir bart mp cav uff comm mme mlle st ste van von de di el al abou abu ben bin la le".split()
FIRM_MARK = (
    r"(?iu)(?:^|\s)(?:c[oy]|ltd|limited|works|usines|s\.?a\.?e|soci[eé]t[eé]|compagnie|banque|bank|company|industries|"
    r"insurance|assurance|trading|navigation|hotels?|mining|filature|textiles?|petroleum|p[eé]troles?|theatres?|"
    r"pressing|propri[eé]taire|land)(?:\s|\.|,|$)|&"
)
# Words that stand apart from the line before them when lines are joined.
FUNCTION_WORDS = (
    "de du des la le les et en au aux a à pour par sur ou ce ces son ses dans avec chez comme sous vers entre que qui dont ainsi "
    "of the and in for to d l qu n s c j m t"
).split()
# Offices and decorations that are printed against a name.
NAME_TAIL = (
    r"(?iu)(?<=\S)\s+(?:anc(?:ien|\.)\b|(?:anc(?:ien|\.)\s+)?(?:d[eé]put[eé]|s[eé]nateur|ministre|magistrat|gouverneur|ambassadeur|"
    r"consul(?:\s+g[eé]n[eé]ral)?|chambellan|sous[\s-]secr[eé]taire|conseiller|commandeur|officier|chevalier|grand[\s-]croix|"
    r"croix\s+de\s+guerre)\b).*$"
)
# Roles as printed, in the order in which they are tried at each place.
ROLES = (
    (r"\bAdm\.?[- ]?D[ée]l[ée]gu[ée]?\b\.?", "managing_director"),
    (r"\bVice[- ]?Pr[ée]s\.", "vice_president"),
    (r"\bPr[ée]s\.\s*d[ue]\s*[Cc]ons\w*\.?", "president"),
    (r"\bPr[ée]s\.", "president"),
    (r"\bAdm\.", "director"),
    (r"\bDir\.\s*G[ée]n\w*\.?", "general_manager"),
    (r"\bDir\.", "manager"),
    (r"\bMemb\.", "member"),
    (r"\bCens\.", "auditor"),
    (r"[Pp]r[eé]sident\w*\s+d[ue]\s+[Cc]ons\w*(?:\s+d\W*[Aa]dmi\w*)?", "president"),
    (r"[Vv]ice[- ]?[Pp]r[eé]sident", "vice_president"),
    (r"[Pp]r[eé]sident", "president"),
    (r"\w*dministrateur[- ]?D[eé]l[eé]gu\w*", "managing_director"),
    (r"\w*dministrateur[- ]?(?:[Gg][ée]rant|[Dd]irecteur|[Dd][ée]l[ée]gu[ée]?)\w*", "managing_director"),
    (r"\w*dministrateur", "director"),
    (r"\w*embre\w*\s+d[ue]\s+[Cc]ons\w*\s+d\W*[Aa]dmi\w*", "director"),
    (r"\w*embre\w*\s+d[ue]\s+[Cc]omit\w*", "committee_member"),
    (r"\w*embre\w*\s+d[ue]\s+[Cc]ons\w*", "council_member"),
    (r"\w*embre", "member"),
    (r"[Dd]irecteur\w*\s+[GgÉé]\w*", "general_manager"),
    (r"[Dd]irecteur\s+[Ll]ocal", "manager"),
    (r"\w*irecteur", "manager"),
    (r"[Cc]ommissaire\w*", "auditor"),
    (r"[Cc]enseur\w*", "auditor"),
    (r"[Cc]onseiller\w*", "adviser"),
    (r"[Ll]iquidateur\w*", "liquidator"),
    (r"[Aa]ssoci[eé]\w*", "partner"),
    (r"[Dd][eé]l[eé]gu[eé]\w*", "delegate"),
    (r"[Gg][eé]rant\w*", "manager"),
)
# What may stand between a role and its organisation, any number of times; how a bare clause begins;
# where a clause's second organisation begins.
CONNECTOR = (
    r"(?iu)^(?:\s*(?:et\s+)?(?:[cdl]{1,2}\W*administration|['’]\s*admini\w*|suppl[eé]ants?|adjoints?|"
    r"(?:du|des|[ec]lu|cle)\s+conseils?\w*(?:\s+d\W*admi\w*)?|de\s+la\s+direction|"
    r"fondateur|honoraire|sortant|actuel|g[eé]n[eé]ral|local)\b[\s,]*)+"
)
BARE = r"(?iU)^\W*(?:de\s+l['’]|de\s+la\s+|de\s+les\s+|des\s+|du\s+|de\s+|d['’]|l['’])"
SECOND = r"(?U)\s+et\s+(?=d[eu']|l['’]|la\b|des\b)"
# Prefixes of a name.
PREFIXES = "s.a.r. s.a.s. s.e. s.a. s.m. mm. mme mlle m. dr. dr me ing. prof. sir lord lady hon. rev. prince princesse comte comtesse baron baronne cheikh sheikh chekh general gen. colonel col. commandant capitaine".split()
#: Ranks from the lowest to the highest.
RANK_ORDER = {"agha": 1, "effendi": 1, "bey": 2, "pasha": 3}

POSITIONS = "array<struct<role:string,organisation:string,firm:boolean>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once for a row, however often body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squeeze(text: Column, edges: str = "") -> Column:
    """Runs of white space as one blank, without white space and ``edges`` at either end."""
    return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), rf"^[\s{edges}]+|[\s{edges}]+$", "")


def _words_fit(tokens: Column, small: list[str]) -> Column:
    """Whether each token begins with a capital or no letter, or is one of the words that are printed small."""
    plain = lambda t: F.regexp_replace(F.lower(fold(t)), "^['’]+|['’]+$", "")
    return F.forall(tokens, lambda t: ~t.rlike(r"^\p{L}") | t.rlike(r"^\p{Lu}") | plain(t).isin(*small))


def like_person(name: Column) -> Column:
    """One to six words, one of three letters at least, none of them small but particles, and no mark of a firm."""
    tokens = F.filter(F.split(name, r"[\s.]+"), lambda t: t != "")
    fit = let(tokens, lambda t: F.size(t).between(1, 6) & F.exists(t, lambda x: F.length(x) >= 3) & _words_fit(t, NAME_WORDS))
    return ~name.rlike(FIRM_MARK) & fit


def opens_entry(line: Column) -> Column:
    """Whether a line begins an entry: a person's name, then a comma."""
    return let(F.regexp_extract(line, ENTRY, 2), lambda name: (name != "") & like_person(name))


def joined_entries(body: Column) -> Column:
    """Array of a page's entries, each on one line. Running heads, single letters and numbers alone go.

    A line that opens no entry goes on with the one above: after a blank if it begins with a capital, a
    digit or a function word, or the line above ends in no letter; else as the rest of a word.
    """
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: squeeze_ends(x)), lambda x: (x != "") & ~running_head(x) & ~x.rlike(r"^[A-ZÀ-Þ]$") & ~x.rlike(r"(?U)^[\d\W_]+$"))

    def apart(line: Column, above: Column) -> Column:
        first = F.regexp_extract(line, r"^([^\s,;.'’]*)", 1)
        return F.lower(fold(first)).isin(*FUNCTION_WORDS) | first.rlike(r"^[\p{Lu}\p{N}]") | ~above.rlike(r"\p{L}$")

    def glued(all_: Column) -> Column:
        mark = lambda line, i: F.when(i == 0, "").when(opens_entry(line), "\n").when(apart(line, F.get(all_, i - 1)), " ").otherwise("")
        return F.array_join(F.transform(all_, lambda line, i: F.concat(mark(line, i), line)), "")

    return F.filter(F.split(let(lines, glued), "\n"), opens_entry)


def squeeze_ends(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def mend_words(text: Column, words: tuple[str, ...] = tuple(BREAKABLE)) -> Column:
    """Words that a scan breaks, whole and as they are spelt here, with a capital where one was printed; and l for I in articles."""
    text = F.regexp_replace(text, r"(?i)\b(de|du|des)\s+[I1l\]|]([ae])\b", "$1 l$2")
    text = F.regexp_replace(text, r"\b[I1](['’])", "l$1")
    # without white space and case, whatever matches is the word (to a pattern, these three letters are an i and an s, too)
    bare = lambda t: F.lower(F.translate(F.translate(t, "\u0130\u0131\u017f", "iis"), " \t\n\x0b\f\r", ""))

    def mended(t: Column, plain: Column) -> Column:
        for w in words:
            t = _whole(t, w, plain.contains(w))
        return t

    return let(text, lambda t: let(bare(t), lambda plain: mended(t, plain)))


def _whole(text: Column, word: str, held: Column) -> Column:
    """Text with a word put together where it is broken or spelt otherwise, if it is held at all."""
    rest = "|".join([word[1:], *[rf"{word[1:i]}\s{word[i:]}" for i in range(2, len(word) - 1)]])
    spelt = lambda t, first: F.regexp_replace(t, rf"{first}(?iu:{rest})", first + word[1:])
    return let(text, lambda t: F.when(held, spelt(spelt(t, word[0].upper()), word[0])).otherwise(t))


def given_names(part: Column) -> Column:
    """Whether what stands between two commas goes on with a name: no role in it, and capitals but for titles."""
    plain = squeeze_ends(part)
    tokens = F.filter(F.split(F.regexp_replace(plain, r"\([^)]*\)", " "), r"[\s.;,]+"), lambda t: t != "")
    fit = let(tokens, lambda t: (F.size(t) > 0) & _words_fit(t, GIVEN_WORDS))
    return F.length(plain).between(2, 40) & ~plain.rlike(role_pattern()) & fit


def role_pattern() -> str:
    # where none can begin, it is seen at once
    return r"(?U)(?=[AaCcDdGgLlMPpVv]|\w*(?:dministrateur|embre|irecteur))(?:" + "|".join(p for p, _ in ROLES) + ")"


def entry_parts(entry: Column) -> Column:
    """struct(honorific, name, body) of an entry; the name with what follows its first comma if that is still the name,
    without brackets and without offices printed against it. Null for what is no entry."""

    def parts(e: Column) -> Column:
        def named(rest: Column) -> Column:
            inverted = F.regexp_extract(rest, r"^([^,;]{2,40}),\s*(?=[A-ZÀ-Þ])", 1)
            return let((inverted != "") & given_names(inverted), lambda more: split(rest, inverted, more))

        def split(rest: Column, inverted: Column, more: Column) -> Column:
            body = F.when(more, F.regexp_replace(F.substring(rest, F.length(inverted) + 2, F.length(rest)), r"^\s+", "")).otherwise(rest)
            whole = F.when(more, F.concat_ws(" ", squeeze(F.regexp_extract(e, ENTRY, 2)), squeeze(inverted, ".,;"))).otherwise(squeeze(F.regexp_extract(e, ENTRY, 2)))
            plain = squeeze_ends(F.regexp_replace(whole, "[()]", " "))
            name = let(squeeze(F.regexp_replace(plain, NAME_TAIL, ""), ".,;"), lambda short: F.when(short != "", short).otherwise(squeeze(plain, ".,;")))
            hon = squeeze_ends(F.regexp_extract(e, ENTRY, 1))
            return F.struct(F.when(hon != "", hon).alias("honorific"), name.alias("name"), body.alias("body"))

        head = F.length(F.regexp_extract(e, ENTRY, 0))
        return let(F.substring(e, head + 1, F.length(e)), named)

    return F.when(entry.rlike(ENTRY), let(entry, parts))


def role_of(printed: Column) -> Column:
    """The role of what role_pattern() has matched: that of the first pattern which begins there."""
    return F.coalesce(*[F.when(printed.rlike(rf"(?U)^(?:{p})"), role) for p, role in ROLES])


def positions(body: Column) -> Column:
    """Array of (role, organisation, firm) of an entry's body, clause by clause.

    A clause has all roles that it names over what follows the last of them; one that names none and
    begins with a preposition has those of the clause before, and any other has no position.
    """

    def step(done: Column, clause: Column) -> Column:
        def read(x: Column) -> Column:
            named = F.size(x["own"]) > 0
            roles = F.when(named, x["own"]).when(x["bare"], done["roles"]).otherwise(F.expr("cast(array() as array<string>)"))
            parts = F.split(F.regexp_replace(x["tail"], CONNECTOR, ""), SECOND)
            orgs = F.filter(F.transform(parts, lambda p: organisation(p)), lambda o: (F.length(o) >= 3) & o.rlike("[A-Za-zÀ-ÿ]{3}"))
            new = F.flatten(F.transform(orgs, lambda o: F.transform(roles, lambda r: F.struct(r.alias("role"), o.alias("organisation"), is_firm(o, r).alias("firm")))))
            return F.struct(F.when(named, x["own"]).otherwise(done["roles"]).alias("roles"), F.concat(done["out"], new).alias("out"))

        found = F.transform(F.regexp_extract_all(clause, F.lit(role_pattern()), F.lit(0)), lambda m: role_of(m))
        tail = F.element_at(F.split(clause, role_pattern(), -1), -1)
        return let(F.struct(F.array_distinct(found).alias("own"), clause.rlike(BARE).alias("bare"), tail.alias("tail")), read)

    clauses = F.filter(F.split(body, r"\s*[;:]\s*"), lambda c: squeeze_ends(c) != "")
    none = F.struct(F.expr("cast(array() as array<string>)").alias("roles"), F.expr(f"cast(array() as {POSITIONS})").alias("out"))
    return F.aggregate(clauses, none, step, lambda d: d["out"])


def person(printed: Column) -> Column:
    """struct(display, rank, prefix, key, surname_key) of a printed name.

    A prefix goes, then ranks at the end, of which the foremost counts; the keys are those of what is left.
    """
    known = "|".join(p.replace(".", r"\.") for p in sorted(PREFIXES, key=len, reverse=True))
    tail = rf"(?i)(?:(?:^|\s+)[.,;]*(?:{'|'.join(RANKS)})[.,;]*)+$"

    def parts(s: Column) -> Column:
        prefix = F.regexp_extract(s, rf"(?i)^({known})\s+", 1)
        rest = F.regexp_replace(s, rf"(?i)^(?:{known})\s+", "")

        def ranked(r: Column) -> Column:
            kept = F.left(r, F.length(F.regexp_replace(fold(r), tail, "")))
            first = F.lower(F.regexp_extract(F.substring(fold(r), F.length(kept) + 1, F.length(r)), rf"(?i)({'|'.join(RANKS)})", 1))
            rank = F.coalesce(*[F.when(first == form, name) for form, name in RANKS.items()])
            return F.struct(squeeze(kept, ",;").alias("display"), rank.alias("rank"), F.when(prefix != "", F.lower(prefix)).alias("prefix"))

        return let(rest, ranked)

    def keyed(x: Column) -> Column:
        return let(name_key(x["display"]), lambda k: F.struct(x["display"].alias("display"), x["rank"].alias("rank"), x["prefix"].alias("prefix"), k.alias("key"), F.substring_index(k, " ", -1).alias("surname_key")))

    return let(let(squeeze(printed, r",;.•\-"), parts), keyed)
