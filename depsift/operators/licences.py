"""Licence names, kinds, obligations and contamination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names in build files of the licences with an identifier.
NAMES = {
    "Apache-2.0": ("The Apache Software License, Version 2.0", "Apache License, Version 2.0", "Apache 2", "Apache 2.0", "Apache License 2.0", "ASL 2.0", "Apache Software License - Version 2.0", "Apache v2"),
    "MIT": ("MIT License", "The MIT License", "MIT"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "Revised BSD License", "The BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "GPL-2.0-only": ("GNU General Public License, version 2", "GPL v2", "GPLv2"),
    "GPL-3.0-only": ("GNU General Public License, version 3", "GPL v3", "GPLv3"),
    "LGPL-2.1-only": ("GNU Lesser General Public License", "LGPL v2.1"),
    "LGPL-3.0-only": ("LGPL v3.0",),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License - v 2.0"),
    "EPL-1.0": ("Eclipse Public License 1.0", "Eclipse Public License - v 1.0"),
    "EDL-1.0": ("Eclipse Distribution License 1.0",),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License Version 2.0", "MPL 2.0"),
    "CDDL-1.0": ("Common Development and Distribution License", "CDDL 1.0"),
    "CDDL-1.1": ("CDDL 1.1",),
    "ISC": ("ISC License",),
    "CC0-1.0": ("CC0 1.0 Universal", "CC0"),
}
# Obligations by licence as (kind, severity); -or-later licences have those of -only.
_FREE = (("Attribution", "MEDIUM"), ("NoWarranty", "LOW"))
_GPL = (("Disclosure", "HIGH"), ("Attribution", "MEDIUM"), ("Copyleft", "HIGH"), ("PatentGrant", "LOW"), ("SourceCodeDistribution", "HIGH"))
_AGPL = (("Disclosure", "HIGH"), ("NetworkUse", "HIGH"), ("Attribution", "MEDIUM"), ("Copyleft", "HIGH"), ("SourceCodeDistribution", "HIGH"))
OBLIGATIONS = {
    "MIT": _FREE,
    "Apache-2.0": (("Attribution", "MEDIUM"), ("PatentGrant", "LOW"), ("NoticeFile", "MEDIUM"), ("NoWarranty", "LOW")),
    "GPL-3.0-only": _GPL, "GPL-3.0-or-later": _GPL, "AGPL-3.0-only": _AGPL, "AGPL-3.0-or-later": _AGPL,
    "BSD-2-Clause": _FREE,
    "BSD-3-Clause": (("Attribution", "MEDIUM"), ("Trademark", "LOW"), ("NoWarranty", "LOW")),
    "MPL-2.0": (("Disclosure", "MEDIUM"), ("Attribution", "MEDIUM"), ("PatentGrant", "LOW")),
}
# Licences by kind, and those that one of the two foundations does not approve of.
KINDS = {
    "Permissive": (
        "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "CC0-1.0", "Unlicense", "Apache-1.1", "BSD-1-Clause", "BSD-3-Clause-Clear", "BSL-1.0", "WTFPL", "Zlib",
        "Python-2.0", "PostgreSQL", "X11", "Artistic-2.0", "CC-BY-4.0", "EDL-1.0", "W3C", "Beerware", "Apache-1.0", "MS-PL", "NCSA", "OpenSSL", "OFL-1.1", "PHP-3.01", "Ruby", "TCL", "Vim", "AFL-3.0",
    ),
    "Copyleft": (
        "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.0-only", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MPL-1.1", "MPL-2.0",
        "EPL-1.0", "EPL-2.0", "CDDL-1.0", "CDDL-1.1", "CPL-1.0", "IPL-1.0", "MS-RL", "OSL-3.0", "CC-BY-SA-4.0",
    ),
    "StrongCopyleft": ("AGPL-3.0-only", "AGPL-3.0-or-later"),
    "Proprietary": ("JSON",),
    "Unknown": ("NOASSERTION",),
}
NOT_OSI = (
    "CC0-1.0", "Unlicense", "BSD-3-Clause-Clear", "WTFPL", "X11", "CC-BY-4.0", "CC-BY-SA-4.0", "JSON", "CDDL-1.1", "EDL-1.0", "W3C", "Beerware", "Apache-1.0", "OpenSSL", "Ruby", "TCL", "Vim", "NOASSERTION",
)
NOT_FSF = (
    "EPL-2.0", "BSD-3-Clause-Clear", "PostgreSQL", "EPL-1.0", "MPL-1.1", "CDDL-1.0", "CPL-1.0", "JSON", "CDDL-1.1", "EDL-1.0", "IPL-1.0", "W3C", "Beerware", "MS-PL", "MS-RL", "OpenSSL", "PHP-3.01",
    "TCL", "Vim", "NOASSERTION",
)
COPYLEFT = (
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-3.0-only", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0",
)


def normalize_license(name: Column) -> Column:
    """Identifier of a licence by its name in a build file; null for other names."""
    out = F
    for licence, names in NAMES.items():
        out = out.when(name.isin(*names), licence)
    return out


def license_info(licence: Column) -> Column:
    """(category, osi, fsf, copyleft) of an identifier; null if it is not known."""
    kind = F
    for k, licences in KINDS.items():
        kind = kind.when(licence.isin(*licences), k)
    info = F.struct(kind.alias("category"), (~licence.isin(*NOT_OSI)).alias("osi"), (~licence.isin(*NOT_FSF)).alias("fsf"), kind.isin("Copyleft", "StrongCopyleft").alias("copyleft"))
    return F.when(kind.isNotNull(), info)


def license_obligations(licence: Column) -> Column:
    """Array of (kind, severity) of what a licence asks for; empty for one not known."""
    out = F
    for k, asked in OBLIGATIONS.items():
        out = out.when(licence == k, F.array(*[F.struct(F.lit(a).alias("kind"), F.lit(s).alias("severity")) for a, s in asked]))
    return F.coalesce(out, F.array().cast("array<struct<kind: string, severity: string>>"))


def license_contamination(dependencies: DataFrame, by: str) -> DataFrame:
    """Warnings of each project: (by, group, n, licences, risk) for copyleft, network copyleft and unknown licences."""
    licence = F.col("license")
    unknown = licence.isNull() | licence.isin("Unknown", "NOASSERTION", "NONE", "")
    groups = F.array_compact(F.array(
        F.when(licence.isin(*COPYLEFT), F.struct(F.lit("copyleft").alias("group"), F.lit("High").alias("risk"))),
        F.when(licence.isin(*KINDS["StrongCopyleft"]), F.struct(F.lit("network copyleft").alias("group"), F.lit("Critical").alias("risk"))),
        F.when(unknown, F.struct(F.lit("unknown").alias("group"), F.lit("High").alias("risk"))),
    ))
    rows = dependencies.withColumn("g", F.explode(groups))
    licences = F.array_sort(F.collect_set(F.coalesce("license", F.lit("Unknown")))).alias("licences")
    return rows.groupBy(by, "g.group", "g.risk").agg(F.count("*").alias("n"), licences)
