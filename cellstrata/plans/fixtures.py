"""Views over the given tables that play the part of a slide: cells, genes, contacts.

The text of a view runs in Spark and in other SQL engines; ``{name}`` stands
for a table or another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "cells": """
        select cast(c_custkey as bigint) as cell_id,
               cast(10*(c_custkey % 40) as double) + cast((c_custkey*7919) % 13 as double)*cast(0.25 as double) as x,
               cast(10*floor(c_custkey/40) as double) + cast((c_custkey*104729) % 13 as double)*cast(0.25 as double) as y,
               case when c_custkey % 29 = 0 then null
                    when (cast(floor((c_custkey % 40)/8) as int) + cast(floor(c_custkey/400) as int)) % 2 = 0 then 'Tumor'
                    else c_mktsegment end as classification,
               cast(c_nationkey as int) as annotation_id
        from {customer}""",
    "annotations": """
        select cast(n_nationkey as int) as annotation_id, n_name as name,
               case when n_regionkey % 2 = 0 then 'Region_A' else 'Region_B' end as classification
        from {nation}""",
    "expr": """
        select cast(o_custkey as bigint) as cell_id, p_brand as gene, cast(sum(l_quantity) as double) as n
        from {lineitem} join {orders} on l_orderkey = o_orderkey join {part} on l_partkey = p_partkey
        group by o_custkey, p_brand""",
    "measurements": "select cell_id, 'total' as name, cast(sum(n) as double) as value from {expr} group by cell_id",
    "lr_pairs": """
        select distinct p_brand as ligand, concat('Brand#', reverse(substr(p_brand, 7))) as receptor from {part}
        union all select 'ABSENT', 'Brand#1'""",
    "gene_map": "select concat('G', cast(p_partkey as varchar(20))) as symbol, cast(p_partkey as bigint) as gene_id from {part} where p_size > 3",
    "go_assoc": """
        select cast(p_partkey as bigint) as gene_id, concat('T:', p_type) as go_id, 'BP' as ns from {part}
        union all select cast(p_partkey as bigint), concat('S:', cast(p_size as varchar(20))), 'MF' from {part}
        union all select cast(p_partkey as bigint), concat('B:', p_brand), 'CC' from {part}""",
    "study_genes": "select concat('G', cast(p_partkey as varchar(20))) as symbol from {part} where p_retailprice > cast(950 as double) and p_size <= 12",
    "points": """
        select event_id as point_id, cast((event_id*7919) % 400 as double) as x, cast((event_id*104729) % 400 as double) as y, event_type as label
        from {events}""",
    "boxes": """
        select cast(s_suppkey as bigint) as object_id,
               cast((s_suppkey % 10)*40 as double) as x0, cast(floor(s_suppkey/10)*40 as double) as y0,
               cast((s_suppkey % 10)*40 + 25 as double) as x1, cast(floor(s_suppkey/10)*40 + 45 as double) as y1
        from {supplier}""",
    "pixels": """
        select l_suppkey as tile_id, l_orderkey as px, l_linenumber as py,
               cast((l_partkey*7) % 256 as int) as r, cast((l_partkey*13 + l_linenumber) % 256 as int) as g, cast((l_orderkey*3) % 256 as int) as b
        from {lineitem}""",
    # four kinds of cells, of which each counts genes of its own half of the time; genes 0 to 19 are common
    "flow_expr": """
        select cast(o_custkey as bigint) as cell_id, concat('P', cast(g as varchar(20))) as gene, cast(sum(l_quantity) as double) as n
        from (select o_custkey, l_quantity, case when l_linenumber = 1 then l_partkey % 20
                     when l_linenumber % 2 = 0 then 50 * (o_custkey % 4) + l_partkey % 50 else l_partkey % 200 end as g
              from {lineitem} join {orders} on l_orderkey = o_orderkey)
        group by o_custkey, g""",
    "flow_cells": "select cell_id, concat('k', cast(cell_id % 4 as varchar(20))) as classification from {cells}",
    "flow_map": "select distinct concat('P', cast(p_partkey % 200 as varchar(20))) as symbol, cast(p_partkey % 200 as bigint) as gene_id from {part}",
    "flow_assoc": """
        select distinct gene_id, concat('T', cast(cast(floor(gene_id / 10) as int) as varchar(20))) as go_id, 'BP' as ns from {flow_map}
        union all select distinct gene_id, concat('U', cast(gene_id % 7 as varchar(20))), 'MF' from {flow_map}""",
    "predictions": """
        select cell_id, classification as truth, case when cell_id % 7 = 0 then 'Tumor' else classification end as predicted
        from {cells} where classification is not null""",
}

#: Only for oracles; Spark takes ``radius_graph``.
ORACLE_VIEWS = VIEWS | {
    "edges": """
        select a.cell_id as src, b.cell_id as dst
        from {cells} a join {cells} b on a.cell_id <> b.cell_id
         and abs(a.x-b.x) <= cast(13 as double) and abs(a.y-b.y) <= cast(13 as double)
         and (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) <= cast(169 as double)""",
}


class Tables:
    """``t("cells")``: the frame of a view or of a given table."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        if name == "edges":
            from cellstrata.operators.graph import radius_graph

            return radius_graph(self("cells"), 13.0)
        if name not in VIEWS:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        needs = set(re.findall(r"\{(\w+)\}", VIEWS[name]))
        return self.spark.sql(VIEWS[name], **{n: self(n) for n in needs})


def oracle(sql: str) -> str:
    """``sql`` with the views that it names in braces as common table expressions."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\{(\w+)\}", text):
            if name in ORACLE_VIEWS and name not in order:
                need(ORACLE_VIEWS[name])
                order.append(name)

    need(sql)
    plain = lambda s: re.sub(r"\{(\w+)\}", r"\1", s)
    views = ",\n".join(f"{n} as ({plain(ORACLE_VIEWS[n])})" for n in order)
    body = plain(sql).strip()
    if not views:
        return body
    recursive, rest = re.match(r"(?is)(with\s+recursive\s+|with\s+)?(.*)", body).groups()
    head = "with recursive " if recursive and "recursive" in recursive.lower() else "with "
    return f"{head}{views}{', ' if recursive else ' '}{rest}"
