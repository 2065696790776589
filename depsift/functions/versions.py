"""Version strings: order-preserving sort keys, range tests and upgrade distances, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEMVER = r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$"


def _part(v: Column, n: int) -> Column:
    return F.regexp_extract(v, SEMVER, n)


def number_key(digits: Column) -> Column:
    """A text that sorts as the number does, however long: the number of its digits, then these without leading zeros."""
    bare = F.regexp_replace(digits, r"^0+(?=\d)", "")
    return F.concat(F.lpad(F.length(bare).cast("string"), 4, "0"), bare)


def semver_parts(v: Column) -> Column:
    """(major, minor, patch, pre) of a semver 2.0 string; null if it is none. A number beyond a long is null."""
    whole = F.struct(*[_part(v, i).try_cast("long").alias(n) for i, n in enumerate(("major", "minor", "patch"), 1)], _part(v, 4).alias("pre"))
    return F.when(v.rlike(SEMVER), whole)


def semver_key(v: Column) -> Column:
    """A string that sorts as the version does; null if it is no semver.

    Numbers sort by value, pre-release identifiers rank numeric before text and shorter before longer, and a
    release ranks after its pre-releases.
    """
    ident = lambda x: F.when(x.rlike(r"^\d+$"), F.concat(F.lit("0"), number_key(x))).otherwise(F.concat(F.lit("1"), x))
    pre = F.array_join(F.transform(F.split(_part(v, 4), r"\."), ident), "!")
    tail = F.when(_part(v, 4) == "", F.lit("~")).otherwise(pre)
    return F.when(v.rlike(SEMVER), F.concat(*[number_key(_part(v, i)) for i in (1, 2, 3)], tail))


def compare_keys(a: Column, b: Column) -> Column:
    """-1, 0 or 1; null where a key is null."""
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def semver_compare(a: Column, b: Column) -> Column:
    return compare_keys(semver_key(a), semver_key(b))


def apk_key(v: Column) -> Column:
    """Sort key of an apk version: leading digits of the dotted parts (parts without any are dropped), then the release.

    The release is what follows the last `-r`, 0 if that is no number. Parts may be any number: one that ends sorts as
    with zeros, so zeros at the end are left out, and the end sorts before any other part.
    """
    base, release = F.regexp_replace(v, r"(?s)-r(?!.*-r).*$", ""), F.regexp_extract(v, r"(?s)^.*-r(\d+)$", 1)
    numbers = F.filter(F.transform(F.split(base, r"\."), lambda p: F.regexp_extract(p, r"^(\d+)", 1)), lambda p: p != "")
    joined = F.array_join(F.transform(numbers, lambda n: F.concat(F.lit("."), number_key(n))), "")
    return F.concat(F.regexp_replace(joined, r"(\.00010)+$", ""), F.lit("!"), number_key(_or_zero(release)))


def _or_zero(digits: Column) -> Column:
    return F.coalesce(F.nullif(digits, F.lit("")), F.lit("0"))


def _deb_order(text: Column) -> Column:
    """Sort key by Debian policy: by turns a run of other characters and a number, which is 0 where digits are absent.

    In a run, `~` sorts before its end, then letters, then the rest. The end of a text is the end of an empty run.
    """
    code = lambda c: F.when(c == "~", F.lit("0")).when(c.rlike("[A-Za-z]"), F.concat(F.lit("3"), c)).otherwise(F.concat(F.lit("4"), c))
    run = lambda t: F.array_join(F.transform(F.regexp_extract_all(F.regexp_extract(t, r"^(\D*)", 1), F.lit("(?s)."), F.lit(0)), code), "")
    pairs = F.regexp_extract_all(text, F.lit(r"\D*\d+|\D+"), F.lit(0))
    pairs = F.when(F.size(pairs) > 0, pairs).otherwise(F.array(F.lit("0")))
    coded = F.transform(pairs, lambda t: F.concat(run(t), F.lit("1"), number_key(_or_zero(F.regexp_extract(t, r"(\d*)$", 1)))))
    return F.concat(F.array_join(coded, ""), F.lit("1"))


def deb_key(v: Column) -> Column:
    """Sort key of a Debian version: epoch, upstream version, revision.

    `~` sorts before everything, even the end, as Debian policy asks for; an absent revision equals 0.
    """
    epoch, rest = number_key(_or_zero(F.regexp_extract(v, r"^(\d+):", 1))), F.regexp_replace(v, r"^\d+:", "")
    revision = F.regexp_extract(rest, r"(?s)-([^-]*)$", 1)
    return F.concat(epoch, _deb_order(F.regexp_replace(rest, r"(?s)-[^-]*$", "")), F.lit("/"), _deb_order(revision))


def rpm_key(v: Column) -> Column:
    """Sort key of an rpm version: epoch, then parts between dots and dashes; numbers rank above text.

    Parts may be any number, and a version that ends sorts as one with zeros. So a part is coded together with the zeros in
    front of it: text after zeros lies below the end, and the less so the more zeros there are; a greater number lies
    above the end, and the more so the fewer there are.
    """
    epoch = F.when(v.rlike(r"^\d+:"), F.regexp_extract(v, r"^(\d+):", 1)).otherwise(F.lit("0"))
    parts = F.split(F.regexp_replace(v, r"(?s)^[^:]*:", ""), r"[.\-]")
    start = F.struct(F.lit(0).alias("zeros"), F.lit("").alias("key"))
    number = lambda s, p: F.concat(s["key"], F.lit("3"), F.lpad((F.lit(9_999_999) - s["zeros"]).cast("string"), 7, "0"), number_key(p))
    text = lambda s, p: F.concat(s["key"], F.lit("1"), F.lpad(s["zeros"].cast("string"), 7, "0"), p, F.lit("\x01"))
    added = lambda s, p: F.when(p.rlike(r"^0+$"), F.struct((s["zeros"] + 1).alias("zeros"), s["key"].alias("key"))).otherwise(
        F.struct(F.lit(0).alias("zeros"), F.when(p.rlike(r"^\d+$"), number(s, p)).otherwise(text(s, p)).alias("key"))
    )
    return F.concat(number_key(epoch), F.aggregate(parts, start, added, lambda s: F.concat(s["key"], F.lit("2"))))


def parse_version3(v: Column) -> Column:
    """(major, minor, patch) after dropping what follows a dash; null unless three all-digit parts."""
    base = F.element_at(F.split(v, "-"), 1)
    parts = F.split(base, r"\.")
    return F.when(base.rlike(r"^\d+\.\d+\.\d+$"), F.struct(*[parts[i].try_cast("long").alias(n) for i, n in enumerate(("major", "minor", "patch"))]))


def _last(events: Column, kind: str) -> Column:
    found = F.filter(F.transform(events, lambda e: e[kind]), lambda x: x.isNotNull())
    return F.get(F.reverse(found), F.lit(0))


def keyed_ranges(ranges: Column) -> Column:
    """The ranges with their bounds as text and as semver keys, so that a version is compared and no bound is parsed again."""

    def one(r: Column) -> Column:
        start, fixed, last = (_last(r["events"], k) for k in ("introduced", "fixed", "last_affected"))
        low = F.when(start == "0", semver_key(F.lit("0.0.0"))).otherwise(semver_key(start))
        return F.struct(
            r["type"].alias("type"), start.alias("start"), fixed.alias("fixed"), last.alias("last"),
            low.alias("low_key"), semver_key(fixed).alias("fixed_key"), semver_key(last).alias("last_key"),
        )

    return F.transform(ranges, one)


def in_keyed_ranges(version: Column, key: Column, keyed: Column, strict: bool = False) -> Column:
    """`version_affected` of a version and its `semver_key` in `keyed_ranges`."""

    def one(r: Column) -> Column:
        below = F.when(r["fixed_key"].isNotNull(), key < r["fixed_key"]).when(r["last_key"].isNotNull(), key <= r["last_key"]).otherwise(F.lit(True))
        semver = F.when(key.isNotNull(), F.coalesce(key >= r["low_key"], F.lit(True)) & below)
        low = r["start"].isNull() | (r["start"] == "0") | (version >= r["start"])
        high = (r["fixed"].isNull() | (version < r["fixed"])) & (r["last"].isNull() | (version <= r["last"]))
        text = low & high & (r["start"].isNotNull() | r["fixed"].isNotNull() | r["last"].isNotNull())
        loose = F.coalesce(semver, text) if strict else F.coalesce(semver, F.lit(False)) | text
        return F.when(r["type"] == "SEMVER", semver).when(r["type"] == "ECOSYSTEM", loose).when(r["type"] == "GIT", text).otherwise(F.lit(True))

    return F.exists(keyed, one)


def version_affected(version: Column, ranges: Column, strict: bool = False) -> Column:
    """Whether any range of {type, events} holds the version; null when a SEMVER range meets an invalid version.

    A semver range takes the last event of each kind, "0" for the start of all, `fixed` before `last_affected`, and a bound
    that does not parse for none. ECOSYSTEM ranges also fall back to text order when semver says no, unless `strict`; in
    text order all bounds hold, and there is one at least. Joins key both sides first, see `keyed_ranges`.
    """
    return in_keyed_ranges(version, semver_key(version), keyed_ranges(ranges), strict)


def _number(v: Column, n: int) -> Column:
    """The n-th dotted part as a number; 0 when missing, null when it is none."""
    part = F.get(F.split(v, r"\."), F.lit(n))
    return F.when(part.isNull(), F.lit(0)).when(part.rlike(r"^\d+$"), part.try_cast("long"))


def semver_upgrade_risk(old: Column, new: Column) -> Column:
    a, b = semver_parts(old), semver_parts(new)
    return (
        F.when(a.isNull() | b.isNull(), "Medium").when(a["major"] != b["major"], "High").when(a["minor"] != b["minor"], "Medium").otherwise("Low")
    )


def os_upgrade_risk(installed: Column, fixed: Column) -> Column:
    a, b = (F.split(x, r"[.\-:]") for x in (installed, fixed))
    return (
        F.when(fixed.isNull(), "NoFix").when(F.get(a, F.lit(0)) != F.get(b, F.lit(0)), "High")
        .when(F.coalesce(F.get(a, F.lit(1)), F.lit("")) != F.coalesce(F.get(b, F.lit(1)), F.lit("")), "Medium").otherwise("Low")
    )


def major_jumps(old: Column, new: Column) -> Column:
    """Major versions between, 0 to 6; 0 when a version has no number or one beyond a long."""
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(6), _number(new, 0) - _number(old, 0))), F.lit(0))


def breaking_estimate(old: Column, new: Column) -> Column:
    """Breaking changes to expect: 8 for a major, 2 for a minor, 0 for a patch difference, 1 if unreadable."""
    known = F.coalesce(_number(old, 0), _number(old, 1), _number(old, 2)).isNotNull()
    ok = known & _number(old, 0).isNotNull() & _number(new, 0).isNotNull() & _number(old, 1).isNotNull() & _number(new, 1).isNotNull()
    ok &= _number(old, 2).isNotNull() & _number(new, 2).isNotNull()
    return F.when(~ok, 1).when(_number(old, 0) != _number(new, 0), 8).when(_number(old, 1) != _number(new, 1), 2).otherwise(0)


def fix_effort_hours(severity: Column, old: Column, new: Column, breaking: Column) -> Column:
    """Half an hour, plus severity, version distance and half an hour a breaking change, to the quarter hour."""
    by_severity = F.when(severity == "CRITICAL", 2.0).when(severity == "HIGH", 1.0).when(severity == "MEDIUM", 0.5).otherwise(0.25)
    readable = _number(old, 0).isNotNull() & _number(new, 0).isNotNull() & _number(old, 1).isNotNull() & _number(new, 1).isNotNull()
    distance = F.when(~readable, 0.0).when(_number(old, 0) != _number(new, 0), 4.0).when(_number(old, 1) != _number(new, 1), 1.0).otherwise(0.0)
    return F.round((F.lit(0.5) + by_severity + distance + breaking * 0.5) * 4) / 4
