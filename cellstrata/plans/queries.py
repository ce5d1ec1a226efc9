"""Registered queries over the given tables, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cellstrata.functions import compare, geometry
from cellstrata.operators import assign, communities, datasets, enrich, expression, graph, register, select, spatial, tiles
from cellstrata.plans.fixtures import Tables, oracle
from cellstrata.plans.lineage import large

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(t)``; ``t(name)`` is a table or view."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = oracle(sql)
        return f

    return add


def r6(*names: str) -> dict:
    return {n: F.round(n, 6) for n in names}


# ---- minimum slice ------------------------------------------------------

_ENRICH = """
    near as (select src as seed, dst as cell_id from {edges} union all select cell_id, cell_id from {cells}),
    enr as (select seed as cell_id, count(*) as total, round(avg(case when classification in ('Tumor') then 1.0::double else 0.0::double end), 6) as prob
            from near join {cells} c using (cell_id) group by seed)"""
_LAYERS = """
    target as (select cell_id from {cells} where classification in ('Tumor')),
    other as (select cell_id from {cells} where classification not in ('Tumor')),
    reach(cell_id, layer) as (
        select distinct src, 1 from {edges} where src in (select cell_id from target) and dst in (select cell_id from other)
        union
        select e.dst, r.layer + 1 from reach r join {edges} e on e.src = r.cell_id where e.dst in (select cell_id from target) and r.layer < 14),
    layers as (select cell_id, min(layer)::int as layer from reach group by cell_id)"""


@query("flagship_tumour_depth", f"with recursive {_ENRICH}, {_LAYERS} select cell_id, total, prob, layer from enr left join layers using (cell_id)")
def _(t):
    cells, edges = t("cells"), t("edges")
    share = graph.neighbourhood_enrichment(cells, edges, ["Tumor"], k=1)
    depth = graph.boundary_layers(cells, edges, ["Tumor"])
    return share.join(large(depth), "cell_id", "left").withColumns(r6("prob"))


# ---- selection ----------------------------------------------------------


@query("q1_cells_in", "select cell_id, annotation_id from {cells} where annotation_id in (select annotation_id from {annotations} where classification = 'Region_A')")
def _(t):
    return select.cells_in(t("cells"), t("annotations").where("classification = 'Region_A'")).select("cell_id", "annotation_id")


@query("q2_opponents", "select distinct classification from {cells} where classification is not null and classification <> 'Tumor'")
def _(t):
    return select.opponents(t("cells"), ["Tumor"])


@query("q3_effective_class", "select cell_id, a.classification as effective from {cells} c left join {annotations} a using (annotation_id)")
def _(t):
    return select.effective_class(t("cells").drop("name"), t("annotations"), "annotation").select("cell_id", "effective")


@query("q4_sample_cells")
def _(t):
    return select.sample_cells(t("cells"), 100, seed=3)


@query("q5_target_opponent", "select cell_id, case when classification = 'Tumor' then 1 else 0 end as label from {cells} where classification is not null")
def _(t):
    return select.split_target_opponent(t("cells"), ["Tumor"])


@query("q6_replace_measurement", "select cell_id, 'total' as name, value + 1 as value from {measurements}")
def _(t):
    m = t("measurements")
    return select.replace_measurement(m, "total", m.withColumn("value", F.col("value") + 1))


# ---- registration -------------------------------------------------------

PARAMS = {
    "width": 400, "height": 400, "flip_horizontal": True, "rotation": -90, "source_scale": 2.0, "target_scale": 4.0,
    "affine": [0.9, 0.1, 5.0, -0.1, 0.9, 7.0], "shift_x": 1.5,
}


@query("r1_to_pixels", "select point_id, round(x / 0.325::double, 6) as x, round(y / 0.325::double, 6) as y from {points}")
def _(t):
    return register.to_pixels(t("points"), 0.325).select("point_id", *[F.round(c, 6).alias(c) for c in "xy"])


@query("r2_flip", "select point_id, 400 - x as x, 400 - y as y from {points}")
def _(t):
    return register.flip(t("points"), 400.0, 400.0, True, True).select("point_id", "x", "y")


@query("r3_rotate", "select point_id, 400 - y as x, x as y from {points}")
def _(t):
    return register.rotate(t("points"), 90, 400.0, 400.0).select("point_id", "x", "y")


@query("r4_scale", "select point_id, round(x * 3::double / 2 * 0.5, 6) as x, round(y * 3::double / 2 * 0.5, 6) as y from {points}")
def _(t):
    return register.scale(t("points"), 3.0, 2.0, 0.5).select("point_id", *[F.round(c, 6).alias(c) for c in "xy"])


@query("r5_affine", "select point_id, round(0.9::double*x + 0.1::double*y + 5, 6) as x, round(-0.1::double*x + 0.9::double*y + 7, 6) as y from {points}")
def _(t):
    return register.affine(t("points"), PARAMS["affine"]).select("point_id", *[F.round(c, 6).alias(c) for c in "xy"])


@query(
    "r6_inverse_affine",
    "select point_id, round((0.9::double*(x - 5) - 0.1::double*(y - 7)) / 0.82::double, 6) as x, round((0.1::double*(x - 5) + 0.9::double*(y - 7)) / 0.82::double, 6) as y from {points}",
)
def _(t):
    m = [PARAMS["affine"][:3], PARAMS["affine"][3:], [0, 0, 1]]
    return register.inverse_affine(t("points"), m).select("point_id", *[F.round(c, 6).alias(c) for c in "xy"])


_SPLINE = """
    steps as (select unnest([-1, 0, 1, 2]) as d),
    near as (select point_id, u, v, floor(u)::int + a.d as i, floor(v)::int + b.d as j from p, steps a, steps b),
    grid as (select i, j, i * 100.0::double + j as cx, j * 90.0::double - i as cy from range(0, 7) a(i), range(0, 7) b(j)),
    w as (select point_id, abs(u - i) as du, abs(v - j) as dv, cx, cy from near join grid using (i, j)),
    k as (select point_id, cx, cy,
            (case when du < 1 then (4 - 6*du*du + 3*du*du*du)/6 when du < 2 then power(2-du, 3)/6 else 0 end)
          * (case when dv < 1 then (4 - 6*dv*dv + 3*dv*dv*dv)/6 when dv < 2 then power(2-dv, 3)/6 else 0 end) as w from w),
    warped as (select point_id, sum(w*cx) as x, sum(w*cy) as y from k group by point_id)"""


def _spline_grid(t):
    i = t.spark.range(7).select(F.col("id").cast("int").alias("i"))
    return i.crossJoin(i.withColumnRenamed("i", "j")).selectExpr("i", "j", "i * 100.0D + j as cx", "j * 90.0D - i as cy")


@query("r7_bspline", f"""
    with p as (select point_id, x * 4 / 399::double + 1 as u, y * 4 / 399::double + 1 as v from {{points}}), {_SPLINE}
    select point_id, round(x, 4) as x, round(y, 4) as y from warped""")
def _(t):
    return register.bspline(t("points"), _spline_grid(t), 4, 400, 400, key="point_id").select("point_id", *[F.round(c, 4).alias(c) for c in "xy"])


@query("r8_shift", "select point_id, x + 1.5::double as x, y - 2 as y from {points}")
def _(t):
    return register.shift(t("points"), 1.5, -2.0).select("point_id", "x", "y")


@query("r9_legacy_spots", "select point_id, round((2*x + 0.5::double*y + 3) * 1.25::double + 1, 6) as x, round((0.25::double*x + 3*y + 4) * 1.25::double + 2, 6) as y from {points}")
def _(t):
    out = register.legacy_spots(t("points"), [2, 0.25, 0, 0.5, 3, 0, 3, 4, 1], 1.25, 1.0, 2.0)
    return out.select("point_id", *[F.round(c, 6).alias(c) for c in "xy"])


@query("r10_to_origin", "select point_id, x - (select min(x0) from {boxes}) as x, y - (select min(y0) from {boxes}) as y from {points}")
def _(t):
    fovs = t("boxes").select(F.col("x0").alias("x"), F.col("y0").alias("y"))
    return register.to_origin(t("points"), fovs).select("point_id", "x", "y")


@query("r11_register", """
    with a as (select point_id, y as x, 400 - (400 - x) as y from {points}),
    b as (select point_id, x / 2 as x, y / 2 as y from a)
    select point_id, round((0.9::double*x + 0.1::double*y + 5) * 4 + 1.5::double, 6) as x, round((-0.1::double*x + 0.9::double*y + 7) * 4, 6) as y from b""")
def _(t):
    return register.register(t("points"), PARAMS, "affine").select("point_id", *[F.round(c, 6).alias(c) for c in "xy"])


_AFFINE_THEN_SPLINE = f"""
    a as (select point_id, y / 2 as x, (400 - (400 - x)) / 2 as y from {{points}}),
    b as (select point_id, floor(0.9::double*x + 0.1::double*y + 5 + 0.5::double) as x, floor(-0.1::double*x + 0.9::double*y + 7 + 0.5::double) as y from a),
    p as (select point_id, x * 4 / (int_w - 0.5::double) + 1 as u, y * 4 / (int_h - 0.5::double) + 1 as v from b, (select 360 // 4 as int_w, 410 // 4 as int_h)), {_SPLINE}"""


def _warped(t, whole_pixels):
    params = PARAMS | {"intervals": 4, "target_width": 360, "target_height": 410}
    return register.register(t("points"), params, "bspline", _spline_grid(t), key="point_id", whole_pixels=whole_pixels)


@query("r11_register_spline", f"""
    with {_AFFINE_THEN_SPLINE}
    select point_id, round(coalesce(w.x, 0) * 4 + 1.5::double, 4) as x, round(coalesce(w.y, 0) * 4, 4) as y from a left join warped w using (point_id)""")
def _(t):
    return _warped(t, False).select("point_id", *[F.round(c, 4).alias(c) for c in "xy"])


@query("r11_register_whole_pixels", f"""
    with {_AFFINE_THEN_SPLINE}
    select point_id, floor(coalesce(round(w.x, 9), 0) + 0.5::double) * 4 + 1.5::double as x, floor(coalesce(round(w.y, 9), 0) + 0.5::double) * 4 as y from a left join warped w using (point_id)""")
def _(t):
    return _warped(t, True).select("point_id", "x", "y")


# ---- assignment ---------------------------------------------------------


def _polygons(t):
    return t("boxes").select("object_id", geometry.box_polygon(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("polygon"))


_IN_BOX = "select point_id, max(object_id) as object_id from {points} join {boxes} on x >= x0 and x < x1 and y >= y0 and y < y1 group by point_id"


@query("a1_assign_points", _IN_BOX)
def _(t):
    return assign.assign_points(t("points"), _polygons(t), 40.0)


def _distances(t):
    centre = t("boxes").selectExpr("object_id", "(x0 + x1) / 2 as cx", "(y0 + y1) / 2 as cy")
    d = F.sqrt((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2)
    return assign.assign_points(t("points"), _polygons(t), 40.0).join(t("points"), "point_id").join(centre, "object_id").withColumn("distance", d)


@query("a2_nearest_per_object", f"""
    with hit as ({_IN_BOX}),
    d as (select object_id, point_id, sqrt(power(x - (x0 + x1) / 2, 2) + power(y - (y0 + y1) / 2, 2)) as distance from hit join {{points}} using (point_id) join {{boxes}} using (object_id))
    select object_id, point_id, round(distance, 6) as distance from d qualify row_number() over (partition by object_id order by distance, point_id) = 1""")
def _(t):
    return assign.nearest_per_object(_distances(t)).select("object_id", "point_id", F.round("distance", 6).alias("distance"))


@query("a3_attach_labels", """
    with l as (select point_id as cell_id, max(label) as label from {points} group by point_id)
    select cell_id, coalesce(label, classification) as classification from {cells} left join l using (cell_id)""")
def _(t):
    labels = t("points").groupBy(F.col("point_id").alias("cell_id")).agg(F.max("label").alias("label"))
    return assign.attach_labels(t("cells"), labels).select("cell_id", "classification")


@query("a4_drop_unlabelled", "select cell_id, classification from {cells} where classification is not null")
def _(t):
    return select.drop_unlabelled(t("cells")).select("cell_id", "classification")


@query("a5_filter_features", "select p_partkey, p_type as feature_type, p_brand as gene from {part} where p_type in (select max(p_type) from {part}) and not starts_with(p_brand, 'Brand#1')")
def _(t):
    f = t("part").select("p_partkey", F.col("p_type").alias("feature_type"), F.col("p_brand").alias("gene"))
    return assign.filter_features(f, [f.agg(F.max("feature_type")).first()[0]], "Brand#1")


@query("a6_attach_expression", "select cell_id, classification, gene, n from {cells} join {expr} using (cell_id)")
def _(t):
    return assign.attach_expression(t("cells").select("cell_id", "classification"), t("expr"))


@query("a7_consolidate", "select annotation_id, gene, sum(n) as n from {expr} join {cells} using (cell_id) group by annotation_id, gene")
def _(t):
    return assign.consolidate_to_annotation(t("cells"), t("expr"))


@query("a8_in_tissue", "select s_suppkey, case when s_acctbal > 0 then 1 else 0 end as in_tissue from {supplier} where s_acctbal > 0")
def _(t):
    return assign.in_tissue_only(t("supplier").select("s_suppkey", (F.col("s_acctbal") > 0).cast("int").alias("in_tissue")))


@query("a9_spot_geometry", "select point_id, x - 85 as x0, y - 85 as y0, 169 as width, 169 as height from {points}")
def _(t):
    return assign.spot_geometry(t("points"), 55.0, 0.325).select("point_id", "x0", "y0", "width", "height")


def _spots(t):
    top = t("cells").agg(F.max("y")).first()[0] or 0.0
    return assign.pseudo_spot_grid(t.spark, 400.0, top + 1, 55.0, 100.0)


_SPOTS = """
    h as (select max(y) + 1 as h from {cells}),
    spots as (select concat(r, '_', c) as spot_id, c * 100.0::double + case when r % 2 = 1 then 27.5::double else 0 end as x, r * 87.0::double as y
              from h, range(0, ceil(h / 87)::bigint) a(r), range(0, 4) b(c))"""


@query("a10_pseudo_spots", f"with {_SPOTS} select spot_id, x, y from spots")
def _(t):
    return _spots(t).select("spot_id", "x", "y")


@query("a11_spots_in_regions", f"with {_SPOTS} select spot_id, x, y from spots s where exists (select 1 from {{boxes}} where x >= x0 and x < x1 and y >= y0 and y < y1)")
def _(t):
    return assign.spots_in_regions(_spots(t), _polygons(t), 40.0).select("spot_id", "x", "y")


@query("a12_cells_to_spots", f"""
    with {_SPOTS}
    select spot_id, gene, sum(n) as n from {{cells}} c join spots s on power(c.x - s.x, 2) + power(c.y - s.y, 2) <= 27.5::double * 27.5 join {{expr}} using (cell_id)
    group by spot_id, gene""")
def _(t):
    return assign.aggregate_cells_to_spots(t("cells"), t("expr"), _spots(t), 27.5)


# ---- graph --------------------------------------------------------------


@query("g1_normalise_edges", "select src, dst from {edges}")
def _(t):
    return graph.normalise_edges(t("edges").where("src < dst"))


@query("g2_radius_graph", "select src, dst from {edges}")
def _(t):
    return graph.radius_graph(t("cells"), 13.0)


@query("g2_knn_graph", """
    with d as (select src, dst, power(a.x-b.x, 2) + power(a.y-b.y, 2) as d from {edges} join {cells} a on a.cell_id = src join {cells} b on b.cell_id = dst),
    k as (select src, dst from d qualify row_number() over (partition by src order by d, dst) <= 3)
    select src, dst from k union select dst, src from k""")
def _(t):
    return graph.knn_graph(t("cells"), 3, 13.0)


@query("g3_delaunay", """
    with p as (select cell_id as id, x, y from {cells}),
    pr as (select a.id as a, b.id as b, a.x as ax, a.y as ay, b.x as bx, b.y as by_ from p a join p b on a.id < b.id
           and abs(a.x-b.x) <= 18 and abs(a.y-b.y) <= 18 where power(a.x-b.x, 2) + power(a.y-b.y, 2) <= 324),
    t as (select u.a, u.b, v.b as c, ax, ay, u.bx - ax as bx, u.by_ - ay as by_, v.bx - ax as cx, v.by_ - ay as cy from pr u join (select a, b, bx, by_ from pr) v on u.a = v.a and u.b < v.b),
    q as (select *, 2 * (bx * cy - by_ * cx) as d from t),
    z as (select a, b, c, ax, ay, (cy * (bx*bx + by_*by_) - by_ * (cx*cx + cy*cy)) / d as ux, (bx * (cx*cx + cy*cy) - cx * (bx*bx + by_*by_)) / d as uy from q where abs(d) > 1e-9),
    ok as (select *, ux*ux + uy*uy as r2 from z where ux*ux + uy*uy <= 81),
    e as (select a, b, c from ok where not exists (select 1 from p where id not in (a, b, c) and abs(x - ax - ux) <= 9 and abs(y - ay - uy) <= 9
          and power(x - (ax + ux), 2) + power(y - (ay + uy), 2) < r2 * (1 - 1e-9))),
    s as (select a as src, b as dst from e union select a, c from e union select b, c from e)
    select src, dst from s union select dst, src from s""")
def _(t):
    return graph.delaunay_edges(t("cells"), 9.0)


@query("g4_khop", """
    with one as (select src as seed, dst as cell_id from {edges}),
    two as (select seed, cell_id from one union select a.seed, e.dst from one a join {edges} e on e.src = a.cell_id)
    select seed, cell_id, case when (seed, cell_id) in (select (seed, cell_id) from one) then 1 else 2 end as hop from two where seed <> cell_id""")
def _(t):
    return graph.khop(t("edges"), t("cells").select("cell_id"), 2)


@query("g5_composition", """
    with near as (select src as seed, dst as cell_id from {edges} union all select cell_id, cell_id from {cells}),
    n as (select seed, classification, count(*) as n from near join {cells} using (cell_id) where classification is not null group by all),
    s as (select seed, count(*) - 1 as size from near group by seed),
    g as (select cell_id as seed, k.classification from {cells} cross join (select distinct classification from {cells} where classification is not null) k)
    select seed as cell_id, classification, coalesce(n, 0) as n, round(case when size > 0 then coalesce(n, 0)::double / size end, 6) as prob
    from g left join n using (seed, classification) join s using (seed)""")
def _(t):
    return graph.neighbourhood_composition(t("cells"), t("edges")).withColumns(r6("prob"))


@query("g6_enrichment", f"with {_ENRICH} select * from enr")
def _(t):
    return graph.neighbourhood_enrichment(t("cells"), t("edges"), ["Tumor"], k=1).withColumns(r6("prob"))


@query("g6_enrichment_by_annotation", """
    with near as (select src as seed, dst as cell_id from {edges} union all select cell_id, cell_id from {cells})
    select seed as cell_id, count(*) as total, round(avg(case when a.classification = 'Region_A' then 1.0::double else 0.0::double end), 6) as prob
    from near join {cells} c using (cell_id) left join {annotations} a using (annotation_id) group by seed""")
def _(t):
    out = graph.neighbourhood_enrichment(t("cells"), t("edges"), ["Region_A"], k=1, by="annotation", annotations=t("annotations"))
    return out.withColumns(r6("prob"))


@query("g7_boundary_layers", f"with recursive {_LAYERS} select * from layers")
def _(t):
    return graph.boundary_layers(t("cells"), t("edges"), ["Tumor"])


@query("g8_layers_by_measurement", """
    with recursive m as (select c.cell_id, coalesce(value > 400, false) as hit from {cells} c left join {measurements} m on m.cell_id = c.cell_id),
    reach(cell_id, layer) as (
        select distinct src, 1 from {edges} where src in (select cell_id from m where hit) and dst in (select cell_id from m where not hit)
        union
        select e.dst, r.layer + 1 from reach r join {edges} e on e.src = r.cell_id where e.dst in (select cell_id from m where hit) and r.layer < 3)
    select cell_id, min(layer)::int as layer from reach group by cell_id""")
def _(t):
    return graph.boundary_layers_by_measurement(t("cells"), t("measurements"), t("edges"), "total", ">", 400.0, 3)


@query("g9_predicates", """
    select cell_id, value > 300 as gt, value >= 300 as ge, value < 300 as lt, value <= 300 as le, abs(value - 300) < 1e-9 as eq, abs(value - 300) >= 1e-9 as ne from {measurements}""")
def _(t):
    ops = {"gt": ">", "ge": ">=", "lt": "<", "le": "<=", "eq": "==", "ne": "!="}
    return t("measurements").select("cell_id", *[compare.compared(F.col("value"), op, 300).alias(n) for n, op in ops.items()])


@query("g10_require_measurement", "select cell_id, value, (select count(distinct cell_id) from {measurements}) as having_it from {measurements}")
def _(t):
    m = t("measurements")
    return m.select("cell_id", "value", F.lit(graph.require_measurement(m, "total")).alias("having_it"))


@query("g11_layer_summary", f"""
    with recursive {_LAYERS}
    select layer, count(*) as n from layers group by layer
    union all select 0, count(*) from target where cell_id not in (select cell_id from layers)""")
def _(t):
    cells = t("cells")
    return graph.layer_summary(graph.boundary_layers(cells, t("edges"), ["Tumor"]), cells.where("classification = 'Tumor'").select("cell_id"))


@query("g12_csr", """
    with i as (select cell_id, row_number() over (order by cell_id) - 1 as row_idx from {cells}),
    d as (select row_idx, count(src) as d from i left join {edges} on src = cell_id group by row_idx)
    select row_idx, sum(d) over (order by row_idx)::bigint - d as start, sum(d) over (order by row_idx)::bigint as "end" from d""")
def _(t):
    return graph.adjacency_csr(t("edges"), t("cells"))[0]


@query("g12_csr_entries", """
    with i as (select cell_id, row_number() over (order by cell_id) - 1 as row_idx from {cells})
    select a.row_idx, b.row_idx as col_idx, 1.0::double as data from {edges} join i a on a.cell_id = src join i b on b.cell_id = dst""")
def _(t):
    return graph.adjacency_csr(t("edges"), t("cells"))[1]


# ---- density, interaction, clustering -----------------------------------


@query("d1_kernel_density", """
    with k as (select c.cell_id, sum(exp(-(power(c.x-d.x, 2) + power(c.y-d.y, 2)) / 200)) as density from {cells} c join {cells} d
               on d.classification = 'Tumor' and power(c.x-d.x, 2) + power(c.y-d.y, 2) <= 2500 group by c.cell_id)
    select cell_id, round(coalesce(density, 0), 6) as density from {cells} left join k using (cell_id)""")
def _(t):
    return spatial.kernel_density(t("cells"), ["Tumor"], 10.0).withColumns(r6("density"))


@query("d1_density_by_annotation", """
    with d as (select c.* from {cells} c join {annotations} a using (annotation_id) where a.classification = 'Region_A'),
    k as (select c.cell_id, sum(exp(-(power(c.x-d.x, 2) + power(c.y-d.y, 2)) / 200)) as density from {cells} c join d
          on power(c.x-d.x, 2) + power(c.y-d.y, 2) <= 2500 group by c.cell_id)
    select cell_id, round(coalesce(density, 0), 6) as density from {cells} left join k using (cell_id)""")
def _(t):
    return spatial.kernel_density(t("cells"), ["Region_A"], 10.0, "annotation", t("annotations")).withColumns(r6("density"))


@query("c1_panel_pairs", "select distinct ligand, receptor from {lr_pairs} where ligand in (select gene from {expr}) and receptor in (select gene from {expr})")
def _(t):
    return spatial.panel_pairs(t("lr_pairs"), t("expr"))


@query("c2_fractions", "select cell_id, gene, round(n / sum(n) over (partition by cell_id), 6) as p from {expr}")
def _(t):
    return spatial.expression_fraction(t("expr")).withColumns(r6("p"))


@query("c3_interaction", """
    with p as (select cell_id, gene, n / sum(n) over (partition by cell_id) as p from {expr} where cell_id in (select cell_id from {cells})),
    panel as (select distinct ligand, receptor from {lr_pairs} where ligand in (select gene from p) and receptor in (select gene from p)),
    s as (select src as cell_id, gene, sum(p) as s from {edges} join p on p.cell_id = dst group by src, gene)
    select v.cell_id, ligand, receptor, round(coalesce(1000 * a.p * s.s, 0), 6) as score
    from (select distinct cell_id from p) v cross join panel
    left join p a on a.cell_id = v.cell_id and a.gene = ligand left join s on s.cell_id = v.cell_id and s.gene = receptor""")
def _(t):
    return spatial.cell_cell_interaction(t("cells"), t("expr"), t("edges"), t("lr_pairs")).withColumns(r6("score"))


@query("b1_mean_cell_size", "select round((avg(p_size) + avg(p_retailprice)) / 2, 6) as size from {part}")
def _(t):
    m = t("part").select(F.col("p_partkey").alias("cell_id"), F.expr("stack(2, 'max_diameter', p_retailprice, 'min_diameter', cast(p_size as double)) as (name, value)"))
    return spatial.mean_cell_size(m).withColumns(r6("size"))




_DBSCAN = """
    e as (select a.cell_id as src, b.cell_id as dst from {cells} a join {cells} b on a.cell_id <> b.cell_id and power(a.x-b.x, 2) + power(a.y-b.y, 2) <= 100),
    core as (select cell_id from {cells} left join (select src, count(*) as d from e group by src) on src = cell_id where coalesce(d, 0) + 1 >= 5),
    inward as (select src, dst from e where src in (select cell_id from core) and dst in (select cell_id from core)),
    flow(cell_id, r) as (select cell_id, cell_id from core union select dst, r from flow join inward on src = cell_id),
    own as (select cell_id, min(r) as own from flow group by cell_id),
    border as (select src as cell_id, min(own) as near from e join own on own.cell_id = dst group by src),
    clusters as (select c.cell_id, coalesce(own, near) as cluster_id, own is not null as core from {cells} c left join own on own.cell_id = c.cell_id left join border on border.cell_id = c.cell_id)"""
_POSITION = f"""{_DBSCAN},
    same as (select src, dst from e join clusters a on a.cell_id = src join clusters b on b.cell_id = dst where a.cluster_id = b.cluster_id),
    turn as (select src, degrees(atan2(b.y - a.y, b.x - a.x)) as t from same join {{cells}} a on a.cell_id = src join {{cells}} b on b.cell_id = dst),
    gap as (select src, coalesce(lead(t) over (partition by src order by t), min(t) over (partition by src) + 360) - t as gap from turn),
    widest as (select src, max(gap) as gap from gap group by src),
    positions as (select cell_id, cluster_id, case when cluster_id is null then 'noise' when coalesce(gap, 360) >= 140 then 'edge' else 'center' end as position
                  from clusters left join widest on src = cell_id)"""


def _clusters(t):
    return spatial.dbscan(t("cells"), 10.0, 5)


@query("b2_dbscan", f"with recursive {_DBSCAN} select * from clusters")
def _(t):
    return _clusters(t)


@query("b3_cluster_sizes", f"""
    with recursive {_DBSCAN}
    select *, case when cluster_id is not null then count(*) over (partition by cluster_id) end as cells_in_cluster, count(*) over () as cells_in_image from clusters""")
def _(t):
    return spatial.cluster_sizes(_clusters(t))


@query("b4_cluster_position", f"with recursive {_POSITION} select * from positions")
def _(t):
    return spatial.cluster_position(t("cells"), _clusters(t), graph.radius_graph(t("cells"), 10.0))


@query("b5_edge_degree", f"""
    with recursive {_POSITION},
    inner_reach(cell_id, degree) as (
        select cell_id, 0 from positions where position = 'edge'
        union
        select dst, degree + 1 from inner_reach join same on src = cell_id where degree < 12),
    reached as (select cell_id, min(degree) as degree from inner_reach group by cell_id)
    select cell_id, degree from positions left join reached using (cell_id)""")
def _(t):
    e = graph.radius_graph(t("cells"), 10.0)
    return spatial.edge_degree(spatial.cluster_position(t("cells"), _clusters(t), e), e)


@query("b6_encode_position", f"with recursive {_POSITION} select *, case position when 'center' then 0 when 'edge' then 1 else 2 end as code from positions")
def _(t):
    return spatial.encode_position(spatial.cluster_position(t("cells"), _clusters(t), graph.radius_graph(t("cells"), 10.0)))


# ---- expression ---------------------------------------------------------

_TRIM = """
    g as (select cell_id, count(*) as g from {expr} where n > 0 group by cell_id),
    q as (select quantile_cont(g, 0.02) as q0, quantile_cont(g, 0.98) as q1 from g),
    trimmed as (select * from {expr} where cell_id in (select cell_id from g, q where g > q0 and g < q1))"""
_NORM = """
    tot as (select cell_id, sum(n) as total from {expr} group by cell_id having sum(n) > 0),
    med as (select quantile_cont(total, 0.5) as median from tot),
    normed as (select cell_id, gene, n * median / total as n from {expr} join tot using (cell_id), med)"""


@query("e1_filter_cells", "select cell_id, gene, n from {expr} where cell_id in (select cell_id from {expr} group by cell_id having sum(n) >= 200)")
def _(t):
    return expression.filter_cells(t("expr"), 200)


@query("e2_filter_genes", "select cell_id, gene, n from {expr} where gene in (select gene from {expr} where n > 0 group by gene having count(*) >= 5)")
def _(t):
    return expression.filter_genes(t("expr"))


@query("e3_qc_cells", """
    with r as (select *, row_number() over (partition by cell_id order by n desc, gene) as r from {expr} where n > 0)
    select cell_id, count(*) as genes, sum(n) as total, round(100 * sum(n) filter (r <= 5) / sum(n), 6) as pct_top_5, round(100 * sum(n) filter (r <= 10) / sum(n), 6) as pct_top_10,
           round(ln(1 + count(*)), 6) as log_genes, round(ln(1 + sum(n)), 6) as log_total
    from r group by cell_id""")
def _(t):
    return expression.qc_cells(t("expr"), (5, 10)).withColumns(r6("pct_top_5", "pct_top_10", "log_genes", "log_total"))


@query("e3_qc_genes", """
    select gene, count(*) as cells, sum(n) as total, round(sum(n) / (select count(*) from {cells}), 6) as mean, round(100 * (1 - count(*)::double / (select count(*) from {cells})), 6) as dropout_pct
    from {expr} where n > 0 group by gene""")
def _(t):
    return expression.qc_genes(t("expr"), t("cells").count()).withColumns(r6("mean", "dropout_pct"))


@query("e4_trim", f"with {_TRIM} select * from trimmed")
def _(t):
    return expression.trim_by_genes(t("expr"))


@query("e5_normalise", f"with {_NORM} select cell_id, gene, round(n, 6) as n from normed")
def _(t):
    return expression.normalise_total(t("expr")).withColumns(r6("n"))


@query("e6_log1p", "select cell_id, gene, round(ln(1 + n), 6) as n from {expr}")
def _(t):
    return expression.log_counts(t("expr")).withColumns(r6("n"))


@query("e7_variable_genes", f"""
    with {_NORM}, c as (select count(*)::double as c from {{cells}}),
    m as (select gene, sum(n) / max(c) as m, (sum(n*n) - max(c) * power(sum(n) / max(c), 2)) / (max(c) - 1) as var from normed, c group by gene),
    d as (select gene, ln(1 + m) as mean, case when var > 0 then ln(var / m) end as dispersion from m where m > 0),
    b as (select *, least(19, floor(case when hi > lo then (mean - lo) / ((hi - lo) / 20) else 0 end)) as bin from d, (select min(mean) as lo, max(mean) as hi from d)),
    s as (select bin, avg(dispersion) as a, stddev_samp(dispersion) as sd from b group by bin)
    select gene, round(mean, 6) as mean, round(dispersion, 5) as dispersion, round(case when sd is null then 1 when sd > 0 then (dispersion - a) / sd else 0 end, 4) as z from b join s using (bin)""")
def _(t):
    e = expression.log_counts(expression.normalise_total(t("expr")))
    out = expression.highly_variable_genes(e, t("cells").count())
    return out.select("gene", F.round("mean", 6).alias("mean"), F.round("dispersion", 5).alias("dispersion"), F.round("z", 4).alias("z"))


@query("e8_top_genes", "select gene, sum(n) as total from {expr} group by gene order by total desc, gene limit 10")
def _(t):
    return expression.top_genes_by_mean(t("expr"), 10)


@query("e9_pca")
def _(t):
    return expression.pca(expression.log_counts(expression.normalise_total(t("expr"))), 3)


@query("e10_neighbours", """
    with d as (select a.vec_id as id, b.vec_id as other, sqrt(list_sum([(x[1] - x[2]) * (x[1] - x[2]) for x in list_zip(a.embedding::double[], b.embedding::double[])])) as distance
               from {embeddings} a join {embeddings} b on a.vec_id <> b.vec_id)
    select id, other, round(distance, 5) as distance from d qualify row_number() over (partition by id order by distance, other) <= 5""")
def _(t):
    v = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return expression.neighbours(v, 5).withColumns({"distance": F.round("distance", 5)})


@query("e11_communities")
def _(t):
    return communities.communities(t("edges"))


_BY_CLASS = "lab as (select cell_id, cast(case when classification = 'Tumor' then 1 else 0 end as varchar) as label from {cells} where classification is not null)"
_BY_TOTAL = "lab as (select cell_id, cast(case when value > (select avg(value) from {measurements}) then 1 else 0 end as varchar) as label from {measurements})"
_RANKS = """
    grid as (select cell_id, label, gene, coalesce(ln(1 + n), 0) as v, coalesce(n, 0) as raw from lab cross join (select distinct gene from {expr} where cell_id in (select cell_id from lab)) left join {expr} using (cell_id, gene)),
    rk as (select *, rank() over (partition by gene order by v) + (count(*) over (partition by gene, v) - 1) / 2.0::double as r from grid),
    s as (select gene, label, sum(r) as ranks, count(*)::double as size, avg(raw) as m from rk group by gene, label),
    w as (select s.gene, s.label, (s.ranks - s.size * (s.size + o.size + 1) / 2) / sqrt(s.size * o.size * (s.size + o.size + 1) / 12) as z, log2((s.m + 1e-9) / (o.m + 1e-9)) as lfc
          from s join s o on s.gene = o.gene and s.label <> o.label)"""
_WILCOXON = f"{_BY_CLASS}, {_RANKS}"


def _ranked(t):
    return expression.rank_genes(expression.log_counts(t("expr")), select.split_target_opponent(t("cells"), ["Tumor"]).withColumn("label", F.col("label").cast("string")))


# two tails of the normal distribution by the series of erf whose terms are all positive
_P = """
    tailed as (select *, greatest(0, 1 - 2 / sqrt(pi()) * exp(-z * z / 2) * list_reduce(list_concat([struct_pack(t := abs(z) / sqrt(2::double), s := abs(z) / sqrt(2::double))], [struct_pack(t := k::double, s := 0::double) for k in range(1, 200)]),
               lambda a, b: struct_pack(t := a.t * z * z / (2 * b.t + 1), s := a.s + a.t * z * z / (2 * b.t + 1))).s) as p from w),
    ranked as (select *, p * count(*) over (partition by label) / row_number() over (partition by label order by p, gene) as raw from tailed),
    tested as (select label, gene, z, lfc, p, least(1, min(raw) over (partition by label order by p desc, gene desc rows between unbounded preceding and current row)) as padj from ranked)"""
# the same with the continued fraction of erfc from 3 on: the series overflows where z is large
_P_FAR = _P.replace("greatest(0, 1 - 2", "case when abs(z) >= 3 then exp(-z * z / 2) / sqrt(pi()) / list_reduce(list_concat([abs(z) / sqrt(2::double)], [k / 2::double for k in range(60, 0, -1)]), lambda f, a: abs(z) / sqrt(2::double) + a / f) else greatest(0, 1 - 2").replace("as p from w)", "end as p from w)")


@query("e12_rank_genes", f"with {_WILCOXON}, {_P} select label, gene, round(z, 5) as z, round(lfc, 5) as lfc, round(p, 6) as pvalue, round(padj, 5) as padj from tested")
def _(t):
    return _ranked(t).select("label", "gene", *[F.round(c, d).alias(c) for c, d in (("z", 5), ("lfc", 5), ("pvalue", 6), ("padj", 5))])


@query("e13_cluster_markers", f"""
    with {_BY_TOTAL}, {_RANKS}, {_P_FAR} select label, gene, round(z, 5) as z from tested where lfc > 0.25 and padj < 0.05 qualify row_number() over (partition by label order by tested.z desc, gene) <= 5""")
def _(t):
    m = t("measurements")
    labels = m.crossJoin(m.agg(F.avg("value").alias("mean"))).select("cell_id", (F.col("value") > F.col("mean")).cast("int").cast("string").alias("label"))
    return expression.cluster_markers(expression.rank_genes(expression.log_counts(t("expr")), labels), 5, lfc=0.25).select("label", "gene", F.round("z", 5).alias("z"))


@query("e14_comparative_markers", f"with {_WILCOXON} select gene, round(z, 5) as z from w where label = '1' order by w.z desc, gene limit 5")
def _(t):
    return expression.comparative_markers(_ranked(t), "1", 5).select("gene", F.round("z", 5).alias("z"))


@query("e15_unique_names", """
    select p_partkey as feature_idx, case when r > 0 then concat(p_brand, '-', r) else p_brand end as gene
    from (select p_partkey, p_brand, row_number() over (partition by p_brand order by p_partkey) - 1 as r from {part})""")
def _(t):
    return expression.unique_gene_names(t("part").select(F.col("p_partkey").alias("feature_idx"), F.col("p_brand").alias("gene")))


# ---- terms --------------------------------------------------------------

_FISHER = """
    pop as (select distinct gene_id from {gene_map}),
    st as (select distinct gene_id from {study_genes} join {gene_map} using (symbol)),
    a as (select distinct gene_id, go_id, ns from {go_assoc} where gene_id in (select gene_id from pop)),
    n as (select (select count(*) from st) as n_study, (select count(*) from pop) as n_pop),
    c as (select ns, go_id, count(*) filter (gene_id in (select gene_id from st)) as n_genes, count(*) as n_go from a group by ns, go_id),
    tt as (select * from c, n where n_genes > 0),
    k as (select *, unnest(range(greatest(0, n_go + n_study - n_pop), least(n_go, n_study) + 1)) as k from tt),
    l as (select *, lgamma(n_go+1) - lgamma(k+1) - lgamma(n_go-k+1) + lgamma(n_pop-n_go+1) - lgamma(n_study-k+1) - lgamma(n_pop-n_go-n_study+k+1)
          - lgamma(n_pop+1) + lgamma(n_study+1) + lgamma(n_pop-n_study+1) as ln from k),
    s as (select *, max(ln) filter (k = n_genes) over (partition by ns, go_id) as seen from l),
    p as (select ns, go_id, any_value(n_genes) as n_genes, any_value(n_go) as n_go, any_value(n_study) as n_study, least(1, sum(exp(ln))) as p from s where ln <= seen + 1e-7 group by ns, go_id),
    raw as (select *, p * count(*) over (partition by ns) / row_number() over (partition by ns order by p, go_id) as raw from p),
    fisher as (select *, least(1, min(raw) over (partition by ns order by p desc, go_id desc rows between unbounded preceding and current row)) as q from raw)"""


def _enriched(t):
    genes = enrich.map_symbols(t("study_genes"), t("gene_map"))
    return enrich.go_enrichment(genes, t("gene_map"), t("go_assoc"))


@query("x1_map_symbols", "select symbol, gene_id from {study_genes} join {gene_map} using (symbol)")
def _(t):
    return enrich.map_symbols(t("study_genes"), t("gene_map"))


@query("x2_namespaces", "select gene_id, go_id, ns from {go_assoc} where ns in ('BP', 'CC')")
def _(t):
    return enrich.select_namespaces(t("go_assoc"), mf=False)


@query("x3_enrichment", f"with {_FISHER} select ns, go_id, n_genes, n_go, n_study, round(p, 6) as p from fisher")
def _(t):
    return _enriched(t).select("ns", "go_id", "n_genes", "n_go", "n_study", F.round("p", 6).alias("p"))


@query("x4_bh", f"with {_FISHER} select ns, go_id, round(q, 5) as q from fisher")
def _(t):
    return _enriched(t).select("ns", "go_id", F.round("q", 5).alias("q"))


@query("x5_significant", f"with {_FISHER} select ns, go_id, n_genes from fisher where q < 0.05 and n_genes > 1")
def _(t):
    return enrich.significant_terms(_enriched(t)).select("ns", "go_id", "n_genes")


@query("x6_columns", f"""
    with {_FISHER} select ns, go_id, round(n_genes::double / n_go, 6) as per,
           (select string_agg(gene_id::varchar, ',' order by gene_id) from a where a.ns = f.ns and a.go_id = f.go_id and gene_id in (select gene_id from st)) as study_genes
    from fisher f""")
def _(t):
    return _enriched(t).select("ns", "go_id", F.round("per", 6).alias("per"), F.array_join("study_genes", ",").alias("study_genes"))


@query("x7_top_terms", f"with {_FISHER} select go_id from fisher where n_genes > 1 order by round(p, 12), go_id limit 10")
def _(t):
    return enrich.top_terms(_enriched(t).where("n_genes > 1").withColumn("p", F.round("p", 12))).select("go_id")


def _by_cluster(t):
    return _enriched(t).withColumn("cluster", F.col("ns")).withColumn("p", F.round("p", 9))


@query("x8_curate", f"with {_FISHER} select go_id, ns as cluster from fisher")
def _(t):
    return enrich.curate_terms(_by_cluster(t)).select("go_id", "cluster")


@query("x9_term_text", f"""
    with {_FISHER}, lines as (select ns, string_agg(go_id, ', ' order by round(p, 9), go_id) as line from fisher group by ns)
    select string_agg(line, chr(10) || chr(10) order by ns) as text from lines""")
def _(t):
    return enrich.term_text(_by_cluster(t))


_WEIGHTS = """
    terms as (select distinct go_id from {go_assoc} where ns = 'CC' and gene_id in (select gene_id from {study_genes} join {gene_map} using (symbol))),
    weights as (select symbol as gene, count(*) as weight from (select distinct gene_id, go_id, ns from {go_assoc}) join terms using (go_id) join {gene_map} using (gene_id) group by symbol)"""


def _weights(t):
    genes = enrich.map_symbols(t("study_genes"), t("gene_map"))
    terms = t("go_assoc").where("ns = 'CC'").join(genes.select("gene_id"), "gene_id", "left_semi")
    return enrich.gene_weights(terms, t("go_assoc"), t("gene_map"), t("gene_map").select(F.col("symbol").alias("gene")))


@query("x10_gene_weights", f"with {_WEIGHTS} select gene, weight from weights")
def _(t):
    return _weights(t)


@query("x11_score_cells", """
    with w as (select p_brand as gene, count(*) as weight from {part} where p_size > 25 group by p_brand),
    f as (select cell_id, gene, row_number() over (partition by cell_id order by n desc, gene) as r from {expr}),
    raw as (select cell_id, sum(coalesce(weight, 0)) as raw from f left join w using (gene) where r <= 5 group by cell_id),
    e as (select min(raw) as low, sum(raw - (select min(raw) from raw)) as total from raw)
    select cell_id, round(case when total > 0 then (raw - low)::double / total * 100000 else 0 end, 6) as score from raw, e""")
def _(t):
    w = t("part").where("p_size > 25").groupBy(F.col("p_brand").alias("gene")).agg(F.count(F.lit(1)).alias("weight"))
    return enrich.score_cells(t("expr"), w, 5).withColumns(r6("score"))


def _brand_map(t):
    """Brands as genes, so that they meet ``expr``."""
    brands = t("part").select(F.col("p_brand").alias("symbol"), F.xxhash64("p_brand").alias("gene_id")).distinct()
    assoc = t("part").select(F.xxhash64("p_brand").alias("gene_id"), F.concat(F.lit("T:"), "p_type").alias("go_id"), F.lit("BP").alias("ns")).distinct()
    return brands, assoc


_PREPARED = """
    c1 as (select cell_id from {flow_expr} group by cell_id having sum(n) >= 10),
    g1 as (select gene from {flow_expr} where cell_id in (select cell_id from c1) and n > 0 group by gene having count(*) >= 5),
    f1 as (select * from {flow_expr} where cell_id in (select cell_id from c1) and gene in (select gene from g1)),
    seen as (select cell_id, count(*) as g from f1 where n > 0 group by cell_id),
    f2 as (select * from f1 where cell_id in (select cell_id from seen where g > (select quantile_cont(g, 0.02) from seen) and g < (select quantile_cont(g, 0.98) from seen))),
    tot as (select cell_id, sum(n) as total from f2 group by cell_id),
    e as (select cell_id, gene, ln(1 + n * (select quantile_cont(total, 0.5) from tot) / total) as v from f2 join tot using (cell_id))"""
_RANKED = f"""
    lab as (select cell_id, {{label}} as label from {{{{flow_cells}}}} where cell_id in (select cell_id from e)),
    grid as (select cell_id, label, gene, coalesce(v, 0) as v from lab cross join (select distinct gene from e) left join e using (cell_id, gene)),
    rk as (select *, rank() over (partition by gene order by v) + (count(*) over (partition by gene, v) - 1) / 2.0::double as r from grid),
    s as (select gene, label, sum(r) as ranks, count(*)::double as size, sum(exp(v) - 1) as m from rk group by gene, label),
    o as (select *, sum(size) over (partition by gene) as total, sum(m) over (partition by gene) as all_m from s),
    w as (select gene, label, (ranks - size * (total + 1) / 2) / sqrt(size * (total - size) * (total + 1) / 12) as z, log2((m / size + 1e-9) / ((all_m - m) / (total - size) + 1e-9)) as lfc from o), {_P}"""
# ``study(cluster, gene)``: each cluster against all genes of e
_TERMS = """
    pop as (select distinct gene_id from {flow_map} where symbol in (select gene from e)),
    st as (select distinct cluster, gene_id from study join {flow_map} on symbol = gene where gene_id in (select gene_id from pop)),
    a as (select distinct gene_id, go_id, ns from {flow_assoc} where gene_id in (select gene_id from pop)),
    c as (select cluster, ns, go_id, count(*) as n_genes from a join st using (gene_id) group by all),
    tt as (select *, (select count(*) from a where a.ns = c.ns and a.go_id = c.go_id) as n_go, (select count(*) from st where st.cluster = c.cluster) as n_study, (select count(*) from pop) as n_pop from c),
    k as (select *, unnest(range(greatest(0, n_go + n_study - n_pop), least(n_go, n_study) + 1)) as k from tt),
    l as (select *, lgamma(n_go+1) - lgamma(k+1) - lgamma(n_go-k+1) + lgamma(n_pop-n_go+1) - lgamma(n_study-k+1) - lgamma(n_pop-n_go-n_study+k+1)
          - lgamma(n_pop+1) + lgamma(n_study+1) + lgamma(n_pop-n_study+1) as ln from k),
    sn as (select *, max(ln) filter (k = n_genes) over (partition by cluster, ns, go_id) as seen from l),
    p as (select cluster, ns, go_id, any_value(n_genes) as n_genes, least(1, sum(exp(ln))) as p from sn where ln <= seen + 1e-7 group by cluster, ns, go_id),
    raw as (select *, p * count(*) over (partition by cluster, ns) / row_number() over (partition by cluster, ns order by p, go_id) as raw from p),
    fisher as (select *, least(1, min(raw) over (partition by cluster, ns order by p desc, go_id desc rows between unbounded preceding and current row)) as q from raw),
    top as (select * from fisher where q < 0.05 and n_genes > 1 qualify row_number() over (partition by cluster order by round(p, 12), go_id) <= 10)"""

# the same with p computed once for equal margins, so that equal terms tie, and the order by p itself
_TERMS_BY_MARGINS = (
    _TERMS.replace("as k from tt)", "as k from (select distinct n_genes, n_go, n_study, n_pop from tt))")
    .replace("over (partition by cluster, ns, go_id) as seen", "over (partition by n_genes, n_go, n_study, n_pop) as seen")
    .replace("p as (select cluster, ns, go_id, any_value(n_genes) as n_genes, least(1, sum(exp(ln))) as p from sn where ln <= seen + 1e-7 group by cluster, ns, go_id)",
             "pm as (select n_genes, n_go, n_study, n_pop, least(1, sum(exp(ln) order by k)) as p from sn where ln <= seen + 1e-7 group by all),\n    p as (select cluster, ns, go_id, n_genes, p from tt join pm using (n_genes, n_go, n_study, n_pop))")
    .replace("order by round(p, 12), go_id", "order by p, go_id")
)


def _flow(t):
    return t("flow_expr"), t("flow_map"), t("flow_assoc")


def _shown(df):
    return df.select("ns", "go_id", "n_genes", *[F.round(c, 6).alias(c) for c in ("p", "q")])


@query("x12_forward_high", f"""
    with {_PREPARED}, study as (select 'all' as cluster, gene from e group by gene order by sum(v) desc, gene limit 20), {_TERMS}
    select ns, go_id, n_genes, round(p, 6) as p, round(q, 6) as q from top""")
def _(t):
    return _shown(enrich.forward_high(*_flow(t), genes=20))


@query("x12_forward_comparative", f"""
    with {_PREPARED}, {_RANKED.format(label="case when classification = 'k0' then '1' else '0' end")},
    study as (select 'all' as cluster, gene from tested where label = '1' order by tested.z desc, gene limit 30), {_TERMS}
    select ns, go_id, n_genes, round(p, 6) as p, round(q, 6) as q from top""")
def _(t):
    expr, genes, assoc = _flow(t)
    return _shown(enrich.forward_comparative(t("flow_cells"), expr, ["k0"], genes, assoc, genes=30))


@query("x12_forward_differential", f"""
    with {_PREPARED}, {_RANKED.format(label="classification").replace(_P, _P_FAR)},
    study as (select label as cluster, gene from tested where padj < 0.05 and lfc > 0.5 qualify row_number() over (partition by label order by tested.z desc, gene) <= 30), {_TERMS_BY_MARGINS}
    select cluster, ns, go_id, n_genes, round(p, 6) as p, round(q, 6) as q from top qualify row_number() over (partition by go_id order by p, cluster) = 1""")
def _(t):
    expr, genes, assoc = _flow(t)
    labels = t("flow_cells").select("cell_id", F.col("classification").alias("label"))
    out = enrich.forward_differential(expr, labels, genes, assoc, genes=30, lfc=0.5)
    return out.select("cluster", "ns", "go_id", "n_genes", *[F.round(c, 6).alias(c) for c in ("p", "q")])


@query("x12_reverse_score", """
    with w as (select p_brand as gene, count(distinct p_type) as weight from {part} where concat('T:', p_type) > 'T:M' group by p_brand),
    f as (select cell_id, gene, row_number() over (partition by cell_id order by n desc, gene) as r from {expr}),
    raw as (select cell_id, sum(coalesce(weight, 0)) as raw from f left join w using (gene) where r <= 5 group by cell_id),
    e as (select min(raw) as low, sum(raw - (select min(raw) from raw)) as total from raw)
    select cell_id, round(case when total > 0 then (raw - low)::double / total * 100000 else 0 end, 6) as score from raw, e""")
def _(t):
    brands, assoc = _brand_map(t)
    return enrich.reverse_score(t("expr"), assoc.select("go_id").where("go_id > 'T:M'"), assoc, brands, 5).withColumns(r6("score"))


# ---- tiles --------------------------------------------------------------


def _grid(t):
    top = int(t("cells").agg(F.max("y")).first()[0] or 0)
    return tiles.tile_grid(t.spark, 400, top, 64, 48)


_TILES = """
    hh as (select max(y)::int as h from {cells}),
    tiles as (select c * 48 as x, r * 48 as y, r * 8 + c as tile_id from hh, range(0, 8) a(c), range(0, greatest(0, 1 + trunc((h - 64) / 48.0))::bigint) b(r))"""


@query("m1_tile_grid", f"with {_TILES} select tile_id, x, y from tiles")
def _(t):
    return _grid(t).select("tile_id", "x", "y")


@query("m2_tiles_touching", f"with {_TILES} select tile_id from tiles a where exists (select 1 from {{boxes}} where x < x1 and x0 < x + 64 and y < y1 and y0 < y + 64)")
def _(t):
    return tiles.tiles_touching(_grid(t), t("boxes"), 64.0).select("tile_id")


def _triangles(t):
    """The lower left half of each box."""
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return t("boxes").select("object_id", F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x0", "y1")).alias("polygon"))


@query("m2_tiles_in_regions", f"""
    with {_TILES} select tile_id from tiles a where exists (
        select 1 from {{boxes}} where x <= x1 and x0 <= x + 64 and y <= y1 and y0 <= y + 64
        and (greatest(x, x0) - x0) * (y1 - y0) + (greatest(y, y0) - y0) * (x1 - x0) <= (x1 - x0) * (y1 - y0))""")
def _(t):
    return tiles.tiles_in_regions(_grid(t), _triangles(t), 64.0).select("tile_id")


@query("m3_detection_grid", """
    with hh as (select max(y)::int as h from {cells})
    select c as gx, r as gy, c * 16 - 8.0::double as x, r * 16 - 8.0::double as y from hh, range(0, 25) a(c), range(0, (h // 16)::bigint) b(r)
    where c * 16 >= 8 and r * 16 >= 8 and c * 16 + 24 <= 400 and r * 16 + 24 <= h""")
def _(t):
    top = int(t("cells").agg(F.max("y")).first()[0] or 0)
    return tiles.detection_grid(t.spark, 400, top, 16, 32)


@query("m4_object_windows", "select cell_id, trunc(0.5::double + x - 64 * 0.5::double / 0.4::double / 2)::int as x0, trunc(0.5::double + y - 64 * 0.5::double / 0.4::double / 2)::int as y0, 80 as size from {cells}")
def _(t):
    return tiles.object_windows(t("cells"), 64, 0.5, 0.4)


@query("m5_objects_per_tile", "select tx, ty, count(*) as n from (select floor(x / 64)::bigint as tx, floor(y / 64)::bigint as ty from {cells}) group by tx, ty")
def _(t):
    return tiles.objects_per_tile(t("cells"), 64.0).groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n"))


@query("m6_optical_density", """
    select px, py, tile_id, round(greatest(0, -ln(greatest(r, 1e-10) / 255) * 255 / ln(255)), 5) as od_r, round(greatest(0, -ln(greatest(g, 1e-10) / 255) * 255 / ln(255)), 5) as od_g from {pixels}""")
def _(t):
    return tiles.optical_density(t("pixels")).select("px", "py", "tile_id", F.round("od_r", 5).alias("od_r"), F.round("od_g", 5).alias("od_g"))


@query("m7_stain_matrix")
def _(t):
    m = tiles.stain_matrix(t("pixels"))
    return t.spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(m)], "channel int, first double, second double, third double")


_W1, _W2 = [[0.65, 0.07, 0.0], [0.7, 0.99, 0.0], [0.29, 0.11, 1.0]], [[0.55, 0.1, 0.0], [0.75, 0.95, 0.0], [0.35, 0.3, 1.0]]


def _stain_sql() -> str:
    w, v = _W1, _W2
    det = sum(w[0][i] * (w[1][(i + 1) % 3] * w[2][(i + 2) % 3] - w[1][(i + 2) % 3] * w[2][(i + 1) % 3]) for i in range(3))
    inv = [[(w[(j + 1) % 3][(i + 1) % 3] * w[(j + 2) % 3][(i + 2) % 3] - w[(j + 1) % 3][(i + 2) % 3] * w[(j + 2) % 3][(i + 1) % 3]) / det for j in range(3)] for i in range(3)]
    m = [[sum(v[i][k] * inv[k][j] for k in range(3)) for j in range(3)] for i in range(3)]
    od = ", ".join(f"greatest(0, -ln(greatest({c}, 1e-10) / 255) * 255 / ln(255)) as od_{c}" for c in "rgb")
    new = ", ".join(
        f"least(255, greatest(0, round(255 * exp(-({' + '.join(f'od_{c}*({m[i][j]!r})::double' for j, c in enumerate('rgb'))}) * ln(255) / 255))))::int as {n}"
        for i, n in enumerate("rgb")
    )
    return f"select tile_id, px, py, {new} from (select tile_id, px, py, {od} from {{pixels}})"


@query("m8_normalise_stain", _stain_sql())
def _(t):
    return tiles.normalise_stain(t("pixels"), _W1, _W2)


@query("m9_channel_stats", "select " + ", ".join(f"round(avg({c}) / 255, 6) as mean_{c}, round(stddev_pop({c}) / 255, 6) as std_{c}" for c in "rgb") + " from {pixels}")
def _(t):
    return tiles.channel_stats(t("pixels")).withColumns(r6(*[f"{s}_{c}" for s in ("mean", "std") for c in "rgb"]))


@query("m10_score_tiles", "select tile_id, round(avg(r), 6) as score from {pixels} group by tile_id")
def _(t):
    means = t("pixels").groupBy("tile_id").agg(F.avg("r").alias("r"))
    out = tiles.score_tiles(means, lambda frame: [[x] for x in frame.r])
    return out.select("tile_id", F.round(F.col("scores")[0], 6).alias("score"))


def _scores(t):
    return t("embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 4).alias("scores"))


def _four(df):
    return df.select("vec_id", *[F.round(F.col("scores")[i], 6).alias(f"s{i}") for i in range(4)])


_S4 = "s as (select vec_id, embedding[1:4]::double[] as s from {embeddings})"


@query("m11_shift_normalise", f"with {_S4} select vec_id, " + ", ".join(f"round((s[{i + 1}] - list_min(s)) / (list_sum(s) - 4 * list_min(s)), 6) as s{i}" for i in range(4)) + " from s")
def _(t):
    return _four(tiles.shift_normalise(_scores(t)))


@query("m12_softmax", f"with {_S4} select vec_id, " + ", ".join(f"round(exp(s[{i + 1}]) / (exp(s[1]) + exp(s[2]) + exp(s[3]) + exp(s[4])), 6) as s{i}" for i in range(4)) + " from s")
def _(t):
    return _four(tiles.softmax(_scores(t)))


@query("m13_predict_label", f"with {_S4} select vec_id, list_position(s, list_max(s))::int - 1 as label_idx, concat('objcls:m:', ['a', 'b', 'c', 'd'][list_position(s, list_max(s))]) as prediction, list_max(s) as probability from s")
def _(t):
    return tiles.predict_label(_scores(t), list("abcd"), "m").drop("scores")


def _labels(t):
    p = t("cells").select(F.floor(F.col("x") / 16).alias("gx"), F.floor(F.col("y") / 16).alias("gy"), "classification")
    p = p.groupBy("gx", "gy").agg(F.max(F.when(F.col("classification") == "Tumor", 1).when(F.col("classification").isNotNull(), 0)).alias("label_idx"))
    top = int(t("cells").agg(F.max("y")).first()[0] or 0)
    return tiles.label_grid(tiles.detection_grid(t.spark, 416, top + 16, 16, 16), p)




@query("m14_label_grid", """
    with hh as (select max(y)::int + 16 as h from {cells}),
    p as (select floor(x / 16)::bigint as gx, floor(y / 16)::bigint as gy, max(case when classification = 'Tumor' then 1 when classification is not null then 0 end) as label_idx, 1 as there from {cells} group by all),
    g as (select unnest(range(0, 26 * (h // 16))) as i from hh)
    select i % 26 as gx, i // 26 as gy, (case when there is null then 0 when label_idx is null then 1 else label_idx + 2 end)::int as value from g left join p on gx = i % 26 and gy = i // 26""")
def _(t):
    return _labels(t)


@query("m15_regions_by_label", """
    with recursive hh as (select max(y)::int + 16 as h from {cells}),
    p as (select floor(x / 16)::bigint as gx, floor(y / 16)::bigint as gy, max(case when classification = 'Tumor' then 1 when classification is not null then 0 end) as label_idx from {cells} group by all),
    g as (select gx, gy, label_idx + 2 as value, gy * 2147483648 + gx as code from p, hh where label_idx is not null and gx < 26 and gy < h // 16),
    l as (select a.code as a, b.code as b from g a join g b on a.value = b.value and abs(a.gx - b.gx) + abs(a.gy - b.gy) = 1),
    flow(code, r) as (select code, code from g union select l.b, r from flow join l on l.a = code),
    comp as (select code, min(r) as part from flow group by code)
    select value::int as value, part, count(*) as tiles, count(*) * 256.0::double as area from g join comp using (code) group by value, part""")
def _(t):
    return tiles.regions_by_label(_labels(t), 16.0)


@query("m15_regions_in_base", """
    with recursive hh as (select max(y)::int + 16 as h from {cells}),
    p as (select floor(x / 16)::bigint as gx, floor(y / 16)::bigint as gy, max(case when classification = 'Tumor' then 1 when classification is not null then 0 end) as label_idx from {cells} group by all),
    unit as (select distinct i, j from (select unnest(range(x0::bigint, x1::bigint)) as i, y0, y1 from {boxes}), (select unnest(range(0, h + 64)) as j from hh) where j >= y0 and j < y1),
    base as (select i // 16 as gx, j // 16 as gy, count(*)::double as area from unit group by all),
    g as (select gx, gy, label_idx + 2 as value, gy * 2147483648 + gx as code, area from p join base using (gx, gy), hh where label_idx is not null and gx < 26 and gy < h // 16),
    l as (select a.code as a, b.code as b from g a join g b on a.value = b.value and abs(a.gx - b.gx) + abs(a.gy - b.gy) = 1),
    flow(code, r) as (select code, code from g union select l.b, r from flow join l on l.a = code),
    comp as (select code, min(r) as part from flow group by code)
    select value::int as value, part, count(*) as tiles, round(sum(area), 6) as area from g join comp using (code) group by value, part""")
def _(t):
    return tiles.regions_by_label(_labels(t), 16.0, _polygons(t)).withColumns(r6("area"))


@query("m16_tissue_tiles", """
    with g as (select floor(px / 16)::bigint as gx, floor(py / 16)::bigint as gy, sum(r + g + b)::double / (3 * count(*)) as mean from {pixels} group by 1, 2),
    i as (select *, gx - row_number() over (partition by gy order by gx) as part from g where mean < 128)
    select gx, gy, round(mean, 6) as mean from i qualify count(*) over (partition by gy, part) >= 2""")
def _(t):
    return tiles.tissue_tiles(t("pixels"), 128.0, min_tiles=2).select("gx", "gy", F.round("mean", 6).alias("mean"))  # all in one row of tiles


# ---- data sets ----------------------------------------------------------


def _tables(t):
    return t("cells").select(F.concat_ws("/", "annotation_id", "cell_id").alias("key"), "cell_id", "classification")


@query("t1_images_labels", "select concat(annotation_id, '/', cell_id) as key, classification, c_name as image from {cells} join {customer} on c_custkey = cell_id where classification is not null")
def _(t):
    images = t("customer").select(F.concat_ws("/", "c_nationkey", "c_custkey").alias("key"), F.col("c_name").alias("image"))
    return datasets.join_images_labels(images, _tables(t)).select("key", "classification", "image")


@query("t2_encode_labels", """
    with f as (select classification, row_number() over (order by min(cell_id), classification)::int - 1 as label from {cells} where classification is not null group by classification)
    select cell_id, classification, label from {cells} join f using (classification)""")
def _(t):
    return datasets.encode_labels(_tables(t).where("classification is not null"), "cell_id").select("cell_id", "classification", "label")


@query("t3_balance")
def _(t):
    return datasets.balance_classes(_tables(t).where("classification is not null"), 50)


@query("t4_class_counts", "select classification, count(*) as n from {cells} group by classification")
def _(t):
    return datasets.class_counts(t("cells"))


@query("t5_split")
def _(t):
    return datasets.train_validation_split(_tables(t))


@query("t6_evaluate", """
    with n as (select truth, predicted, count(*) as n from {predictions} group by truth, predicted)
    select truth, predicted, n, round(n / sum(n) over (partition by truth), 6) as share, round((select sum(n) filter (truth = predicted) / sum(n) from n), 6) as accuracy from n""")
def _(t):
    return datasets.evaluate(t("predictions")).withColumns(r6("share", "accuracy"))


@query("t7_validate_tiles", """
    select bool_and(x1 - x0 + 20 = y1 - y0) as square, count(distinct (x1 - x0, y1 - y0 + object_id % 2)) <= 1 as one_size, count(distinct object_id % 3) <= 1 as one_extension from {boxes}""")
def _(t):
    side = t("boxes").select((F.col("x1") - F.col("x0") + 20).alias("w"), (F.col("y1") - F.col("y0")).alias("h"), "object_id")
    square = datasets.validate_tiles(side.select("w", "h", F.lit("png").alias("extension"))).select("square")
    mixed = datasets.validate_tiles(side.select("w", (F.col("h") + F.col("object_id") % 2).alias("h"), (F.col("object_id") % 3).cast("string").alias("extension")))
    return square.crossJoin(mixed.select("one_size", "one_extension"))  # one row each
