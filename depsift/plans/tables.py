"""Supply-chain tables derived from the TPC-H-like test tables.

Each definition is one SQL text that Spark and DuckDB read alike; `{x}` names a table it is made from.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

DEFINITIONS = {
    "components": """
        select p_partkey as component_id, concat(replace(p_name, ' ', '-'), '-', cast(p_partkey % 20 as string)) as name,
               case p_partkey % 5 when 0 then 'npm' when 1 then 'PyPI' when 2 then 'Maven' when 3 then 'Go' else 'crates.io' end as ecosystem,
               concat(cast(p_size % 5 as string), '.', cast(p_partkey % 12 as string), '.', cast(p_partkey % 7 as string)) as version,
               case p_partkey % 8 when 0 then 'MIT' when 1 then 'Apache-2.0' when 2 then 'BSD-3-Clause' when 3 then 'GPL-3.0-only'
                    when 4 then 'GPL-2.0-only' when 5 then 'AGPL-3.0-only' when 6 then 'ISC' end as license,
               p_brand as brand, p_size as size, p_retailprice as price
        from {part}
    """,
    "packages": """
        select p_partkey as package_id, case p_partkey % 9 when 0 then 'npm' when 1 then 'Python' when 2 then 'Go' when 3 then 'Rust' when 4 then 'Ruby' when 5 then 'PHP'
                   when 6 then 'Maven' when 7 then 'Gradle' else 'hex' end as ecosystem,
               case p_partkey % 9 when 0 then case when p_partkey % 4 < 2 then '@scope' end when 2 then case when p_partkey % 5 > 0 then 'github.com/org' end when 3 then 'crates.io'
                   when 4 then 'rubygems.org' when 5 then case p_partkey % 2 when 0 then 'vendor' end when 6 then case when p_partkey % 5 > 1 then 'org.example' end end as namespace,
               concat(case when p_partkey % 9 in (6, 7) and p_partkey % 2 = 0 then 'org.example:' else '' end, replace(p_name, ' ', '-'), '-', cast(p_partkey % 20 as string)) as name,
               concat(cast(p_size % 5 as string), '.', cast(p_partkey % 12 as string), '.', cast(p_partkey % 7 as string)) as version
        from {part}
    """,
    "project_components": """
        select l_orderkey as project, l_partkey as component_id, l_linenumber = 1 as direct from {lineitem}
    """,
    "advisories": """
        select p_partkey as advisory_key, concat('CVE-2024-', lpad(cast(p_partkey as string), 6, '0')) as cve,
               concat('GHSA-', lpad(cast(p_partkey as string), 6, '0')) as ghsa,
               concat(replace(p_name, ' ', '-'), '-', cast(p_partkey % 20 as string)) as name,
               case p_partkey % 5 when 0 then 'npm' when 1 then 'PyPI' when 2 then 'Maven' when 3 then 'Go' else 'crates.io' end as ecosystem,
               concat(cast(p_partkey % 3 as string), '.0.0') as introduced,
               case when p_partkey % 11 > 0 then concat(cast(p_partkey % 3 + 2 as string), '.', cast(p_partkey % 10 as string), '.0') end as fixed,
               cast(p_partkey * 13 % 101 as double) / 10.0 as cvss,
               concat('Flaw in ', p_name, case when p_partkey % 17 = 0 then ': malicious code with a backdoor' else '' end) as summary
        from {part} where p_partkey % 3 = 0
    """,
    "epss": """
        select cve, cast(advisory_key * 37 % 1000 as double) / 1000.0 as epss, cast(advisory_key * 53 % 1000 as double) / 1000.0 as percentile
        from {advisories}
    """,
    "kev": "select cve, concat('2024-0', cast(advisory_key % 9 + 1 as string), '-15') as due_date from {advisories} where advisory_key % 23 = 0",
    "findings": """
        select l.l_orderkey as image, l.l_linenumber as layer, a.cve, a.name as package, c.version as installed, a.fixed, a.cvss, c.ecosystem,
               case when a.cvss >= 9 then 'CRITICAL' when a.cvss >= 7 then 'HIGH' when a.cvss >= 4 then 'MEDIUM' when a.cvss > 0 then 'LOW' else 'UNKNOWN' end as severity,
               case l.l_suppkey % 3 when 0 then 'trivy' when 1 then 'grype' else 'native' end as tool, l.l_suppkey % 3 as tool_order,
               l.l_shipdate as scanned, l.l_quantity > 25 as reachable, e.epss, k.cve is not null as is_kev,
               cast(split(a.fixed, '[.]')[{first}] as int) > cast(split(c.version, '[.]')[{first}] as int) as breaking
        from {lineitem} l join {advisories} a on l.l_partkey = a.advisory_key join {components} c on c.component_id = l.l_partkey
        left join {epss} e on e.cve = a.cve left join {kev} k on k.cve = a.cve
    """,
    "edges": """
        select p_partkey as src, p_partkey * 2 + 1 as dst from {part} where p_partkey * 2 + 1 < (select count(*) from {part})
        union all
        select p_partkey as src, p_partkey * 3 + 2 as dst from {part} where p_partkey * 3 + 2 < (select count(*) from {part})
    """,
}
_DIALECT = re.compile(r"\{first\}")


@lru_cache(maxsize=None)
def parts_of(name: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(x for x in re.findall(r"\{(\w+)\}", DEFINITIONS[name]) if x != "first"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, or one derived from them."""
    if name in RAW:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = _DIALECT.sub("0", DEFINITIONS[name])
    return spark.sql(text, **{x: table(spark, sf_dir, x) for x in parts_of(name)})


def oracle(body: str) -> str:
    """DuckDB SQL of a query over derived tables, each defined in front of it."""
    needed: list[str] = []

    def visit(name: str) -> None:
        if name in DEFINITIONS and name not in needed:
            for x in parts_of(name):
                visit(x)
            needed.append(name)

    for word in re.findall(r"\b\w+\b", body):
        visit(word)
    if not needed:
        return body
    texts = [f"{n} as ({re.sub(r'[{](?!first)(\w+)[}]', r'\1', DEFINITIONS[n])})" for n in needed]
    inner = _DIALECT.sub("1", ",\n".join(texts)).replace("split(a.fixed, '[.]')", "string_split(a.fixed, '.')").replace("split(c.version, '[.]')", "string_split(c.version, '.')")
    rest = body.strip()
    if rest.lower().startswith("with recursive"):
        return f"with recursive {inner},\n{rest[14:]}"
    return f"with {inner},\n{rest[4:]}" if rest.lower().startswith("with ") else f"with {inner}\n{rest}"
