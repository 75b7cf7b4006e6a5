"""The engine's registered queries and their SQL equivalents.

Each query runs an operator over whole volumes that stand for the driver's tables (sources/tables.py); the SQL repeats the
volume's definition in a common table expression.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stratavox.operators import components as cc
from stratavox.operators import curvature, distance, objects, pointwise, renumber, skeletons, stencils, thinning, volume
from stratavox.operators.volume import XYZ
from stratavox.plans import checkpoints
from stratavox.plans.checkpoints import cut
from stratavox.sources import chunks, datasets, voxels
from stratavox.sources.tables import GRID, box, labels, scores

QUERIES = {}
ORACLE_SQL = {}

VOL = """s AS (SELECT l_orderkey % 64 AS x, l_partkey % 64 AS y, (l_suppkey * 7 + l_linenumber) % 32 AS z, CAST(max(CAST(l_quantity AS BIGINT)) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2, 3),
l AS (SELECT o_orderkey % 64 AS x, o_custkey % 64 AS y, o_orderkey * 5 % 32 AS z, max(o_custkey % 40 + 1) AS v FROM orders GROUP BY 1, 2, 3),
o AS (SELECT dx, dy, dz, dx * dx + dy * dy + dz * dz AS d2 FROM (SELECT unnest(range(-3, 4)) AS dx), (SELECT unnest(range(-3, 4)) AS dy), (SELECT unnest(range(-3, 4)) AS dz)),
box AS (SELECT i % 64 AS x, i // 64 % 64 AS y, i // 4096 AS z FROM range(131072) t(i))"""
INSIDE = "{0}.x + dx BETWEEN 0 AND 63 AND {0}.y + dy BETWEEN 0 AND 63 AND {0}.z + dz BETWEEN 0 AND 31"


def query(sql: str | None = None, recursive: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{VOL}{', ' if sql.startswith('+') else ' '}{sql.removeprefix('+')}"
        return f

    return add


# Point-wise


@query("SELECT x, y, z, v FROM s WHERE v >= 35")
def threshold(spark, sf_dir):
    return pointwise.threshold(scores(spark, sf_dir), 35)


@query("SELECT x, y, z, CAST(7 AS BIGINT) AS v FROM l WHERE v > 0")
def binarize(spark, sf_dir):
    return pointwise.binarize(labels(spark, sf_dir), 7)


@query("SELECT x, y, z, v * 11 % 256 AS v FROM s WHERE v * 11 % 256 <> 0")
def cast8(spark, sf_dir):
    return pointwise.cast8(scores(spark, sf_dir).withColumn("v", F.col("v") * 11))


@query("SELECT x - 8 AS x, y - 4 AS y, z - 2 AS z, CAST(255 AS BIGINT) AS v FROM s WHERE v > 0 AND x BETWEEN 8 AND 39 AND y BETWEEN 4 AND 43 AND z BETWEEN 2 AND 17")
def crop(spark, sf_dir):
    return pointwise.crop(scores(spark, sf_dir), GRID, (32.0, 16.0, 11.0), (32, 40, 16), binary=True)


@query("SELECT v, round(128 * ((exp(2.0 * v / 50) - 1) / (exp(2.0 * v / 50) + 1)) + 127, 6) AS intensity, round(25 * ln((1 + (v + 127 - 127) / 128.0) / (1 - (v + 127 - 127) / 128.0)), 6) AS nm, count(*) AS n FROM s GROUP BY v")
def intensity_distance(spark, sf_dir):
    s = scores(spark, sf_dir).groupBy("v").agg(F.count("*").alias("n"))
    return s.select("v", F.round(pointwise.distance_to_intensity(F.col("v").cast("double")), 6).alias("intensity"), F.round(pointwise.intensity_to_distance(F.col("v") + 127), 6).alias("nm"), "n")


@query("SELECT 'low' AS name, x, y, z, CAST(255 AS BIGINT) AS v FROM l WHERE v IN (1, 2, 3) UNION ALL SELECT 'odd', x, y, z, 255 FROM l WHERE v IN (3, 5, 7)")
def remap_classes(spark, sf_dir):
    return pointwise.remap_classes(labels(spark, sf_dir), {"low": [1, 2, 3], "odd": [3, 5, 7]})


@query("SELECT crop, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM (SELECT unnest(['whole', CASE WHEN x < 32 THEN 'x_low' ELSE 'x_high' END, CASE WHEN y < 32 THEN 'y_low' ELSE 'y_high' END, CASE WHEN z < 16 THEN 'z_low' ELSE 'z_high' END]) AS crop, v FROM l) GROUP BY crop")
def validation_crops(spark, sf_dir):
    return pointwise.validation_crops(labels(spark, sf_dir), GRID).groupBy("crop").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("SELECT s.* FROM s SEMI JOIN l USING (x, y, z)")
def mask_include(spark, sf_dir):
    return pointwise.apply_mask(scores(spark, sf_dir), labels(spark, sf_dir), keep_within=True)


@query("SELECT s.* FROM s ANTI JOIN l USING (x, y, z)")
def mask_exclude(spark, sf_dir):
    return pointwise.apply_mask(scores(spark, sf_dir), labels(spark, sf_dir))


@query("SELECT s.* FROM s WHERE EXISTS (SELECT 1 FROM l WHERE l.x = s.x // 2 AND l.y = s.y // 2 AND l.z = s.z // 2)")
def mask_scaled(spark, sf_dir):
    return pointwise.apply_mask(scores(spark, sf_dir), labels(spark, sf_dir), keep_within=True, scale=2)


@query("SELECT s.x, s.y, s.z, l.v FROM s JOIN l ON l.x = s.x // 2 AND l.y = s.y // 2 AND l.z = s.z // 2 WHERE s.v >= 20")
def label_predictions(spark, sf_dir):
    return pointwise.label_predictions(scores(spark, sf_dir), labels(spark, sf_dir), 20, scale=2)


@query("SELECT x, y, z, v FROM l WHERE v IN (3, 9, 27)")
def id_filter_keep(spark, sf_dir):
    return pointwise.filter_ids(labels(spark, sf_dir), keep=spark.createDataFrame([(3,), (9,), (27,)], "v long"))


@query("SELECT x, y, z, CASE WHEN v = 5 THEN 50 ELSE v END AS v FROM l WHERE v NOT IN (3, 9, 27)")
def id_filter_delete(spark, sf_dir):
    return pointwise.filter_ids(labels(spark, sf_dir), drop=spark.createDataFrame([(3,), (9,), (27,)], "v long"), relabel=spark.createDataFrame([(5, 50)], "v long, to long"))


@query("+n AS (SELECT v, count(*) AS n FROM l GROUP BY v), k AS (SELECT v, row_number() OVER (ORDER BY v) AS number FROM n WHERE n > (SELECT avg(n) FROM n) OR v IN (2)) SELECT x, y, z, number AS v FROM l JOIN k USING (v)")
def volume_filter(spark, sf_dir):
    vol = labels(spark, sf_dir)
    mean = vol.groupBy("v").count().agg(F.avg("count")).first()[0]
    return pointwise.volume_filter(vol, mean, always=[2])


@query("SELECT x, y, z, v AS id, CAST(CASE WHEN v <= 5 THEN 2 WHEN v % 2 = 0 AND v / 40.0 >= 0.5 THEN 3 WHEN v % 2 = 0 THEN 4 ELSE 1 END AS BIGINT) AS v FROM l")
def ribosome_classes(spark, sf_dir):
    ids = spark.range(1, 41)
    return pointwise.separate_classes(labels(spark, sf_dir), ids.where("id <= 5"), ids.where("id % 2 = 0").withColumn("sheetness", F.col("id") / 40), 0.5)


@query("SELECT count(*) AS voxels, CAST(sum(CASE WHEN coalesce(s.v, 0) <> coalesce(l.v, 0) THEN 1 ELSE 0 END) AS BIGINT) AS mismatches, sum(CASE WHEN coalesce(s.v, 0) <> coalesce(l.v, 0) THEN 1 ELSE 0 END) = 0 AS equal FROM s FULL JOIN l USING (x, y, z)")
def compare_equal(spark, sf_dir):
    return pointwise.compare(scores(spark, sf_dir), labels(spark, sf_dir))


@query("SELECT count(*) AS voxels, CAST(sum(CASE WHEN (coalesce(s.v, 0) <> 0) <> (coalesce(l.v, 0) <> 0) THEN 1 ELSE 0 END) AS BIGINT) AS mismatches, sum(CASE WHEN (coalesce(s.v, 0) <> 0) <> (coalesce(l.v, 0) <> 0) THEN 1 ELSE 0 END) = 0 AS equal FROM s FULL JOIN l USING (x, y, z)")
def compare_nonzero(spark, sf_dir):
    return pointwise.compare(scores(spark, sf_dir), labels(spark, sf_dir), nonzero_only=True)


@query("SELECT CAST(255 AS BIGINT) AS v, x, y, z FROM box ANTI JOIN s USING (x, y, z)")
def invert(spark, sf_dir):
    return pointwise.invert(scores(spark, sf_dir), box(spark))


@query("SELECT z AS x, y, x AS z, v FROM l WHERE x BETWEEN 5 AND 24 AND y BETWEEN 6 AND 35 AND z BETWEEN 3 AND 12")
def permuted_window(spark, sf_dir):
    return volume.permute(volume.window(labels(spark, sf_dir), (5, 6, 3), (20, 30, 10)), "zyx")


# Blocks and storage


@query("SELECT i AS bx, j AS \"by\", k AS bz, i * 32 - 3 AS ox, j * 32 - 3 AS oy, k * 16 - 3 AS oz, CAST(38 AS BIGINT) AS dx, CAST(38 AS BIGINT) AS dy, CAST(22 AS BIGINT) AS dz FROM (SELECT DISTINCT x // 32 AS i, y // 32 AS j, z // 16 AS k FROM s)")
def padded_blocks(spark, sf_dir):
    """The blocks of a stored volume with a margin of three."""
    return _stored(spark, sf_dir).blocks("scores", 3)


@query("SELECT x // 32 AS bx, y // 32 AS \"by\", z // 16 AS bz, count(*) AS voxels FROM s GROUP BY 1, 2, 3")
def existing_blocks(spark, sf_dir):
    return volume.existing_blocks(scores(spark, sf_dir), GRID)


@query("SELECT x, y, z, v FROM s WHERE v > 0")
def chunk_round_trip(spark, sf_dir):
    return chunks.from_chunks(chunks.to_chunks(scores(spark, sf_dir), GRID, "s", "uint16"))


def _store(spark) -> datasets.Store:
    return datasets.Store(spark, f"{checkpoints.folder(spark)}/store-{uuid.uuid4().hex}")


def _stored(spark, sf_dir) -> datasets.Store:
    """A store with the scores."""
    store = _store(spark)
    store.create("scores", GRID, "uint16")
    store.write("scores", scores(spark, sf_dir))
    return store


@query("SELECT x, y, z, CAST(floor(v / 7.0) AS BIGINT) AS v, 'copy' AS name, 'uint64' AS dtype FROM s WHERE floor(v / 7.0) > 0")
def dataset_copy(spark, sf_dir):
    """A float dataset made like another one, and copied as 64-bit integers."""
    store = _store(spark)
    store.create("plain", GRID, "uint8")
    store.create("real", like="plain", dtype="float32")
    store.write("real", scores(spark, sf_dir).withColumn("v", F.col("v") / 7))
    store.copy("real", "copy")
    return store.read("copy").withColumns({"name": F.lit(store.names()[0]), "dtype": F.lit(store.describe("copy")[1])})


@query("SELECT 'scores' AS name, '64x64x32' AS dim, 'uint16' AS dtype, count(DISTINCT (x // 32, y // 32, z // 16)) AS blocks FROM s UNION ALL SELECT 'labels', '64x64x32', 'uint8', count(DISTINCT (x // 32, y // 32, z // 16)) FROM l")
def dataset_list(spark, sf_dir):
    """A store's datasets with the number of their chunks."""
    store = _stored(spark, sf_dir)
    store.create("labels", like="scores", dtype="uint8")
    store.write("labels", labels(spark, sf_dir))
    counts = None
    for name in store.names():
        own = store.blocks(name).agg(F.count("*").alias("blocks")).withColumn("name", F.lit(name))
        counts = own if counts is None else counts.unionByName(own)
    return store.datasets().join(counts, "name").select("name", F.array_join("dim", "x").alias("dim"), "dtype", "blocks")


@query("SELECT * FROM s WHERE x BETWEEN 3 AND 20 AND y BETWEEN 30 AND 41 AND z BETWEEN 20 AND 28")
def stored_window(spark, sf_dir):
    """A box of a stored volume; chunks that don't meet it aren't decoded."""
    return _stored(spark, sf_dir).window("scores", (3, 30, 20), (18, 12, 9))


@query("SELECT * FROM l WHERE x BETWEEN 3 AND 20 AND y > 40 AND z < 10")
def container_window(spark, sf_dir):
    """A box of an n5 dataset, from the chunk files that meet it."""
    container = f"{checkpoints.folder(spark)}/n5-{uuid.uuid4().hex}"
    chunks.write_n5(labels(spark, sf_dir), GRID, container, "labels", "uint8")
    return voxels.read(spark, container, "labels", box=((3, 41, 0), (18, 23, 10)))[0]


@query("SELECT DISTINCT x // 32 AS gx, y // 32 AS gy, z // 16 AS gz, x // 32 * 32 AS ox, y // 32 * 32 AS oy, z // 16 * 16 AS oz, CAST(32 AS BIGINT) AS dx, CAST(32 AS BIGINT) AS dy, CAST(16 AS BIGINT) AS dz FROM l WHERE v > 20")
def container_chunks(spark, sf_dir):
    """The chunk files of an n5 dataset."""
    container = f"{checkpoints.folder(spark)}/n5-{uuid.uuid4().hex}"
    chunks.write_n5(labels(spark, sf_dir).where("v > 20"), GRID, container, "high", "uint8")
    return voxels.existing_chunks(spark, container, "high")


@query("SELECT 4096 * z + 64 * y + x + 1 AS id, x * 4.0 AS x_nm, y * 4.0 AS y_nm, z * 4.0 AS z_nm FROM l")
def voxel_ids(spark, sf_dir):
    back = labels(spark, sf_dir).select(GRID.index().alias("id"))
    return back.select("id", *(c.alias(k) for k, c in GRID.position(F.col("id")).items())).select("id", *(c.alias(k) for k, c in volume.physical(GRID).items()))


# Stencils


@query("SELECT a.x, a.y, a.z, a.v, count(*) FILTER (WHERE coalesce(b.v, 0) <> a.v AND " + INSIDE.format("a") + ") AS faces FROM l a JOIN o ON d2 = 1 LEFT JOIN l b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY ALL")
def surface_faces(spark, sf_dir):
    return stencils.exposed_faces(labels(spark, sf_dir), GRID)


@query("SELECT DISTINCT a.x, a.y, a.z, a.v FROM l a JOIN o ON d2 BETWEEN 1 AND 3 AND greatest(abs(dx), abs(dy), abs(dz)) = 1 LEFT JOIN l b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz WHERE coalesce(b.v, 0) <> a.v AND " + INSIDE.format("a"))
def surface_voxels_26(spark, sf_dir):
    return stencils.surface_voxels(labels(spark, sf_dir), GRID)


@query("SELECT DISTINCT a.v AS a, b.v AS b FROM l a JOIN o ON d2 BETWEEN 1 AND 3 JOIN l b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz WHERE a.v < b.v")
def touching_objects(spark, sf_dir):
    return stencils.touching_objects(labels(spark, sf_dir), GRID)


@query("SELECT a.v, min(b.v) AS number FROM s a JOIN o ON d2 = 3 AND abs(dx) = 1 AND abs(dy) = 1 JOIN s b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz WHERE a.v % 4 <> 0 AND b.v % 4 = 0 GROUP BY a.v")
def adjacent_ids(spark, sf_dir):
    return stencils.adjacent_kept(scores(spark, sf_dir), spark.range(0, 51, 4).select(F.col("id").alias("v")), GRID)


@query("SELECT x, y, z, sum(w * v) AS g FROM (SELECT x - 1 AS x, y, z, v, 0.5 AS w FROM s UNION ALL SELECT x + 1, y, z, v, -0.5 FROM s) GROUP BY x, y, z HAVING sum(w * v) <> 0")
def gradient(spark, sf_dir):
    return stencils.gradient(scores(spark, sf_dir), "x")


@query("SELECT x, y, z, CAST(sum(w * v) AS DOUBLE) AS g FROM (SELECT x, y - 1 AS y, z, v, 1 AS w FROM s UNION ALL SELECT x, y, z, v, -1 FROM s) GROUP BY x, y, z HAVING sum(w * v) <> 0")
def gradient_forward(spark, sf_dir):
    return stencils.gradient(scores(spark, sf_dir), "y", central=False)


_W = stencils.gaussian_weights(1.0)
_PASS = "(SELECT {keep}, sum(p.v * w.w) AS v, i.p + w.d AS {c} FROM {of} p, LATERAL (SELECT DISTINCT unnest([p.{c}, -p.{c}, {far} - p.{c}]) AS p) i, w WHERE i.p + w.d BETWEEN 0 AND {last} GROUP BY {keep}, i.p + w.d)"


@query("+w AS (SELECT unnest(range(" + f"{1 - len(_W)}, {len(_W)})) AS d, unnest({[_W[abs(k)] for k in range(1 - len(_W), len(_W))]}::DOUBLE[]) AS w), gx AS " + _PASS.format(keep="y, z", c="x", of="l", far=126, last=63) + ", gy AS " + _PASS.format(keep="x, z", c="y", of="gx", far=126, last=63) + ", gz AS " + _PASS.format(keep="x, y", c="z", of="gy", far=62, last=31) + " SELECT x, y, z, round(v, 6) AS v FROM gz WHERE round(v, 6) <> 0")
def gauss(spark, sf_dir):
    return stencils.gaussian(labels(spark, sf_dir), GRID, 1.0).select(*XYZ, F.round("v", 6).alias("v")).where("v <> 0")


@query("+m AS (SELECT x + dx AS x, y + dy AS y, z + dz AS z, max(v) AS most FROM s, o WHERE d2 BETWEEN 1 AND 4 GROUP BY 1, 2, 3) SELECT s.* FROM s LEFT JOIN m USING (x, y, z) WHERE coalesce(most, 0) <= v")
def ribosome_maxima(spark, sf_dir):
    return stencils.local_maxima(scores(spark, sf_dir), GRID, 2)


@query("SELECT l.x + dx AS x, l.y + dy AS y, l.z + dz AS z, max(v) AS v FROM l JOIN o ON d2 <= 4 WHERE " + INSIDE.format("l") + " GROUP BY 1, 2, 3")
def stamp_balls(spark, sf_dir):
    return stencils.stamp_balls(labels(spark, sf_dir), GRID, 2)


@query("+c AS (SELECT a.x, a.y, a.z, a.v, count(*) AS n FROM l a JOIN o ON greatest(abs(dx), abs(dy), abs(dz)) <= 2 JOIN l b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY ALL) SELECT x, y, z, v FROM c WHERE n < 125")
def internal_gradient(spark, sf_dir):
    return stencils.internal_gradient(labels(spark, sf_dir), GRID, 2)


# within two voxels, only lines along an axis pass through a voxel on their way
@query("+p AS (SELECT a.x, a.y, a.z, a.v, dx, dy, dz, coalesce(own.v, 0) >= 20 AND coalesce(t.v, 0) >= 20 AND (d2 < 4 OR coalesce(m.v, 0) >= 20) AS seen FROM l a JOIN o ON d2 <= 4 LEFT JOIN s t ON t.x = a.x + dx AND t.y = a.y + dy AND t.z = a.z + dz LEFT JOIN s m ON m.x = a.x + dx // 2 AND m.y = a.y + dy // 2 AND m.z = a.z + dz // 2 AND d2 = 4 LEFT JOIN s own ON own.x = a.x AND own.y = a.y AND own.z = a.z), f AS (SELECT x, y, z, v, count(*) FILTER (WHERE seen) / count(*) AS fraction, coalesce(sqrt(avg(dx) FILTER (WHERE seen) ** 2 + avg(dy) FILTER (WHERE seen) ** 2 + avg(dz) FILTER (WHERE seen) ** 2), 2.0) AS far FROM p GROUP BY x, y, z, v) SELECT x, y, z, v, round(fraction, 6) AS fraction, round(far, 6) AS \"offset\", round(fraction + 1 - far / 2, 6) AS score FROM f")
def sphereness(spark, sf_dir):
    found = stencils.sphereness(scores(spark, sf_dir), labels(spark, sf_dir), GRID, 2, 20)
    return found.withColumns({c: F.round(c, 6) for c in ("fraction", "offset", "score")})


# Distances. SURFACE is the 26-surface of l.

SURFACE = "+sf AS (SELECT DISTINCT a.x, a.y, a.z, a.v FROM l a JOIN o ON d2 BETWEEN 1 AND 3 LEFT JOIN l b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz WHERE coalesce(b.v, 0) <> a.v AND " + INSIDE.format("a") + "), near AS (SELECT a.x + dx AS x, a.y + dy AS y, a.z + dz AS z, a.v, d2 FROM sf a JOIN o ON d2 <= 9 WHERE " + INSIDE.format("a") + ")"


@query("SELECT a.x + dx AS x, a.y + dy AS y, a.z + dz AS z, min(d2) AS d2 FROM l a JOIN o ON d2 <= 9 WHERE " + INSIDE.format("a") + " GROUP BY 1, 2, 3")
def edt_bounded(spark, sf_dir):
    return distance.edt_bounded(labels(spark, sf_dir), GRID, 9)


@query(SURFACE + " SELECT x, y, z, arg_min(v, struct_pack(d2 := d2, v := v)) AS v FROM near ANTI JOIN l USING (x, y, z) WHERE d2 <= 6 GROUP BY x, y, z UNION ALL SELECT x, y, z, v FROM sf")
def contact_halo(spark, sf_dir):
    return distance.contact_halo(labels(spark, sf_dir), GRID, 6.0)


@query(SURFACE + ", byl AS (SELECT x, y, z, v, min(d2) AS d2 FROM near WHERE d2 <= 4 GROUP BY x, y, z, v), r AS (SELECT x, y, z, list(v ORDER BY d2, v) AS vs FROM byl GROUP BY x, y, z) SELECT x, y, z, least(vs[1], vs[2]) AS a, greatest(vs[1], vs[2]) AS b FROM r WHERE len(vs) > 1")
def self_pair_halo(spark, sf_dir):
    return distance.self_pairs(labels(spark, sf_dir), GRID, 4.0)


@query(SURFACE + " SELECT x, y, z, arg_min(v, struct_pack(d2 := d2, v := v)) AS v FROM near ANTI JOIN l USING (x, y, z) WHERE d2 <= 9 GROUP BY x, y, z UNION ALL SELECT x, y, z, v FROM l")
def expand(spark, sf_dir):
    return distance.expand(labels(spark, sf_dir), GRID, 12.0)


@query(SURFACE + " SELECT DISTINCT x, y, z, CAST(255 AS BIGINT) AS v FROM (SELECT x, y, z FROM near WHERE d2 <= 4 UNION ALL SELECT x, y, z FROM l)")
def expand_fixed(spark, sf_dir):
    return distance.expand(labels(spark, sf_dir), GRID, 8.0, 255)


#: A denser binary volume, in which something is left of erosion: low scores are set, and so are the empty places.
FILLED = "+f AS (SELECT x, y, z, CAST(1 AS BIGINT) AS v FROM box ANTI JOIN (SELECT * FROM s WHERE v >= 48) USING (x, y, z)), e AS (SELECT DISTINCT a.x + dx AS x, a.y + dy AS y, a.z + dz AS z FROM (SELECT * FROM s WHERE v >= 48) a JOIN o ON d2 <= {0})"


def _filled(spark, sf_dir):
    high = scores(spark, sf_dir).where("v >= 48")
    return box(spark).join(high, XYZ, "left_anti").withColumn("v", F.lit(1).cast("long"))


@query(FILLED.format(4) + " SELECT f.* FROM f ANTI JOIN e USING (x, y, z)")
def erode(spark, sf_dir):
    return distance.erode(_filled(spark, sf_dir), GRID, 8.0)


@query(FILLED.format(4) + ", core AS MATERIALIZED (SELECT f.* FROM f ANTI JOIN e USING (x, y, z)), b AS MATERIALIZED (SELECT DISTINCT core.x + dx AS x, core.y + dy AS y, core.z + dz AS z FROM core JOIN (SELECT dx, dy, dz FROM o WHERE d2 <= 4) ON true) SELECT f.*, CASE WHEN b.x IS NULL THEN 'protrusion' ELSE 'body' END AS part FROM f LEFT JOIN b USING (x, y, z)")
def bodies_protrusions(spark, sf_dir):
    return distance.bodies_and_protrusions(_filled(spark, sf_dir), GRID, 8.0)


@query(FILLED.format(4) + " SELECT f.* FROM f SEMI JOIN e USING (x, y, z)")
def expanded_surface(spark, sf_dir):
    return distance.expanded_surface(_filled(spark, sf_dir), GRID, 8.0)


@query(SURFACE + ", m AS (SELECT DISTINCT x, y, z FROM (SELECT x, y, z FROM near WHERE d2 <= 4 UNION ALL SELECT x, y, z FROM l)) SELECT s.* FROM s ANTI JOIN m USING (x, y, z)")
def expand_and_mask(spark, sf_dir):
    return distance.expand_and_apply_mask(scores(spark, sf_dir), labels(spark, sf_dir), GRID, 6.0)


@query("+t AS (SELECT a.x + dx AS x, a.y + dy AS y, a.z + dz AS z, a.v, d2 FROM l a JOIN o ON d2 <= 9 WHERE " + INSIDE.format("a") + ") SELECT x, y, z, v FROM (SELECT x, y, z, arg_min(v, struct_pack(d2 := d2, v := v)) AS v, min(d2) AS d2 FROM t GROUP BY x, y, z) WHERE d2 > 2")
def filament_tubes(spark, sf_dir):
    return distance.filament_tubes(labels(spark, sf_dir), GRID, 12.5, 6.0)


@query(
    "+t AS (SELECT a.x + dx AS x, a.y + dy AS y, a.z + dz AS z, a.v, min(d2) AS d2 FROM l a JOIN o ON d2 <= 9 GROUP BY ALL), nb AS (SELECT a.x, a.y, a.z, a.v, list(struct_pack(d2 := d2, dx := dx, dy := dy, dz := dz) ORDER BY d2, dx, dy, dz) AS n FROM l a JOIN o ON d2 BETWEEN 1 AND 3 JOIN l b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz AND b.v = a.v GROUP BY ALL), "
    "ep AS (SELECT x, y, z, v, -n[1].dx AS ex, -n[1].dy AS ey, -n[1].dz AS ez FROM nb WHERE len(n) = 1 OR len(n) = 2 AND (n[1].dx - n[2].dx) ** 2 + (n[1].dy - n[2].dy) ** 2 + (n[1].dz - n[2].dz) ** 2 < 2), "
    "gone AS (SELECT DISTINCT ep.x + dx AS x, ep.y + dy AS y, ep.z + dz AS z, v FROM ep JOIN o ON d2 <= 9 AND (dx - ex) ** 2 + (dy - ey) ** 2 + (dz - ez) ** 2 <= d2) "
    "SELECT x, y, z, arg_min(v, struct_pack(d2 := d2, v := v)) AS v FROM t ANTI JOIN gone USING (x, y, z, v) WHERE d2 > 2 AND x BETWEEN 0 AND 63 AND y BETWEEN 0 AND 63 AND z BETWEEN 0 AND 31 GROUP BY x, y, z"
)
def trimmed_tubes(spark, sf_dir):
    return distance.trimmed_tubes(labels(spark, sf_dir), GRID, 12.5, 6.0)


@query(SURFACE + ", grown AS (SELECT x, y, z, arg_min(v, struct_pack(d2 := d2, v := v)) AS v FROM near ANTI JOIN l USING (x, y, z) WHERE d2 <= 9 GROUP BY x, y, z UNION ALL SELECT x, y, z, v FROM l) SELECT grown.* FROM grown SEMI JOIN (SELECT * FROM s WHERE v >= 30) p USING (x, y, z)")
def expand_predicted(spark, sf_dir):
    """Labels grown only where the scores predict them."""
    return distance.expand(labels(spark, sf_dir), GRID, 12.0, prediction=scores(spark, sf_dir), at_least=30)


@query("+f AS (SELECT x, y, z, CAST(1 AS BIGINT) AS v FROM box ANTI JOIN (SELECT * FROM s WHERE v >= 48) USING (x, y, z)), g AS MATERIALIZED (SELECT x AS p, y AS q, z AS r FROM s WHERE v >= 48), m AS (SELECT x, y, z, min((x - p) ** 2 + (y - q) ** 2 + (z - r) ** 2) AS d2 FROM f, g GROUP BY x, y, z) SELECT x, y, z, v, CAST(least(coalesce(d2, 1e9), (x + 1) ** 2, (64 - x) ** 2, (y + 1) ** 2, (64 - y) ** 2, (z + 1) ** 2, (32 - z) ** 2) AS DOUBLE) AS d2 FROM f LEFT JOIN m USING (x, y, z)")
def depth(spark, sf_dir):
    return distance.depth(_filled(spark, sf_dir), GRID)


@query("+g AS MATERIALIZED (SELECT x AS p, y AS q, z AS r, v FROM s WHERE v >= 50), d AS (SELECT x, y, z, v, (x - p) * (x - p) + (y - q) * (y - q) + (z - r) * (z - r) AS d2 FROM box, g) SELECT x, y, z, CAST(min(d2 * 64 + v) % 64 AS BIGINT) AS v FROM d WHERE d2 <= 400 GROUP BY x, y, z")
def expand_far(spark, sf_dir):
    """A radius of more than half a block runs over lines."""
    return distance.expand(scores(spark, sf_dir).where("v >= 50"), GRID, 80.0)


@query("+g AS MATERIALIZED (SELECT x AS p, y AS q, z AS r FROM l WHERE v = 7) SELECT DISTINCT x, y, z, CAST(255 AS BIGINT) AS v FROM box, g WHERE (x - p) * (x - p) + (y - q) * (y - q) + (z - r) * (z - r) <= 81")
def expand_far_fixed(spark, sf_dir):
    """One label by more than half a block, with one value: blocks that bounds settle enter no kernel."""
    return distance.expand(labels(spark, sf_dir).where("v = 7"), GRID, 36.0, 255)


@query()
def geodesic(spark, sf_dir):
    return distance.geodesic(labels(spark, sf_dir), _filled(spark, sf_dir), GRID)


# Components

LABELS = "c(id, root) USING KEY (id) AS (SELECT id, id FROM b UNION SELECT e.w, min(r.root) FROM c r JOIN e ON e.u = r.id JOIN recurring.c k ON k.id = e.w WHERE r.root < k.root GROUP BY e.w)"
CC = "+b AS MATERIALIZED (SELECT x, y, z, 4096 * z + 64 * y + x + 1 AS id FROM {1}), e AS MATERIALIZED (SELECT p.id AS u, q.id AS w FROM b p JOIN o ON {0} JOIN b q ON q.x = p.x + dx AND q.y = p.y + dy AND q.z = p.z + dz), " + LABELS + ", cc AS (SELECT id, root AS component FROM c), n AS (SELECT component, count(*) AS n FROM cc GROUP BY component) "

BY_ANY = "d2 BETWEEN 1 AND 3 AND greatest(abs(dx), abs(dy), abs(dz)) = 1"


def _segmented(spark, sf_dir, around=False):
    return cc.components(pointwise.binarize(pointwise.threshold(scores(spark, sf_dir), 35)), GRID, around)


@query(CC.format("d2 = 1", "s WHERE v >= 35") + "SELECT x, y, z, component FROM b JOIN cc USING (id)", recursive=True)
def components_6(spark, sf_dir):
    return _segmented(spark, sf_dir).select(*XYZ, "component")


@query(CC.format(BY_ANY, "l") + "SELECT x, y, z, component FROM b JOIN cc USING (id)", recursive=True)
def components_26(spark, sf_dir):
    return cc.components(pointwise.binarize(labels(spark, sf_dir)), GRID, around=True).select(*XYZ, "component")


@query(CC.format("d2 = 1", "s WHERE v >= 35") + "SELECT x, y, z, component FROM b JOIN cc USING (id) JOIN n USING (component) WHERE n = (SELECT max(n) FROM n)", recursive=True)
def largest_component(spark, sf_dir):
    return cc.largest(_segmented(spark, sf_dir)).select(*XYZ, "component")


@query(CC.format("d2 = 1", "s WHERE v >= 35") + ", k AS (SELECT component, row_number() OVER (ORDER BY component) AS number FROM n WHERE n > 2 AND n <= 9) SELECT x, y, z, number AS v FROM b JOIN cc USING (id) JOIN k USING (component)", recursive=True)
def component_renumber(spark, sf_dir):
    kept = cc.keep_sizes(_segmented(spark, sf_dir), 2, 9).select(*XYZ, F.col("component").alias("v"))
    return renumber.apply_numbers(kept, renumber.dense_numbers(kept.select("v")))


@query(CC.format("d2 = 1", "s WHERE v >= 35") + ", k AS (SELECT x, y, z, component AS v FROM b JOIN cc USING (id) JOIN n USING (component) WHERE n > 2), f AS (SELECT a.x, a.y, a.z, a.v, count(*) FILTER (WHERE coalesce(q.v, 0) <> a.v AND " + INSIDE.format("a") + ") AS faces FROM k a JOIN o ON d2 = 1 LEFT JOIN k q ON q.x = a.x + dx AND q.y = a.y + dy AND q.z = a.z + dz GROUP BY ALL) SELECT v AS id, count(*) * 64.0 AS volume, sum(faces) * 16.0 AS area, round(4.0 * sum(x) / count(*), 6) AS com_x, round(4.0 * sum(y) / count(*), 6) AS com_y, round(4.0 * sum(z) / count(*), 6) AS com_z, min(x) * 4.0 AS min_x, min(y) * 4.0 AS min_y, min(z) * 4.0 AS min_z, max(x) * 4.0 AS max_x, max(y) * 4.0 AS max_y, max(z) * 4.0 AS max_z FROM f GROUP BY v", recursive=True)
def object_info(spark, sf_dir):
    info = objects.object_info(cc.segment(scores(spark, sf_dir), GRID, 35, 2 * 64.0), GRID)
    return info.withColumns({f"com_{c}": F.round(f"com_{c}", 6) for c in XYZ})


SMOOTHED = "+w AS (SELECT unnest(range(" + f"{1 - len(_W)}, {len(_W)})) AS d, unnest({[_W[abs(k)] for k in range(1 - len(_W), len(_W))]}::DOUBLE[]) AS w), gx AS " + _PASS.format(keep="y, z", c="x", of="s", far=126, last=63) + ", gy AS " + _PASS.format(keep="x, z", c="y", of="gx", far=126, last=63) + ", gz AS " + _PASS.format(keep="x, y", c="z", of="gy", far=62, last=31) + ", p AS (SELECT x, y, z FROM gz WHERE round(v) >= 13 AND EXISTS (SELECT 1 FROM l WHERE l.x = gz.x // 2 AND l.y = gz.y // 2 AND l.z = gz.z // 2)), "


@query(SMOOTHED + CC.format("d2 = 1", "p").removeprefix("+") + ", k AS (SELECT component FROM n WHERE n > 3) SELECT x, y, z, component AS v FROM b JOIN cc USING (id) SEMI JOIN k USING (component)", recursive=True)
def segment_smoothed(spark, sf_dir):
    """Scores smoothed, masked by the labels at half the resolution, thresholded and labelled without small components."""
    return cc.segment(scores(spark, sf_dir), GRID, 13, 3 * 64.0, smooth_nm=4.0, mask=labels(spark, sf_dir))


@query(CC.format("d2 = 1", "(SELECT x, y, z FROM box ANTI JOIN s USING (x, y, z) WHERE EXISTS (SELECT 1 FROM l WHERE l.x = box.x // 2 AND l.y = box.y // 2 AND l.z = box.z // 2))") + ", k AS (SELECT component FROM n WHERE n > 5) SELECT x, y, z, component AS v FROM b JOIN cc USING (id) SEMI JOIN k USING (component)", recursive=True)
def segment_holes(spark, sf_dir):
    """Components of the empty places of a mask at half the resolution."""
    places = pointwise.apply_mask(box(spark).withColumn("v", F.lit(1)), labels(spark, sf_dir), keep_within=True, scale=2)
    return cc.segment(scores(spark, sf_dir), GRID, 0, 5 * 64.0, inside=places.select(*XYZ))


@query("SELECT 's' AS object, count(DISTINCT v) AS count FROM s UNION ALL SELECT 'l', count(DISTINCT v) FROM l")
def object_counts(spark, sf_dir):
    return objects.object_counts({"s": scores(spark, sf_dir), "l": labels(spark, sf_dir)})


HOLES = "+f AS (SELECT x, y, z, x // 16 + 1 AS v FROM box ANTI JOIN (SELECT * FROM s WHERE v >= 46) USING (x, y, z)), b AS (SELECT x, y, z, 4096 * z + 64 * y + x + 1 AS id FROM s WHERE v >= 46), e AS (SELECT p.id AS u, q.id AS w FROM b p JOIN o ON d2 = 1 JOIN b q ON q.x = p.x + dx AND q.y = p.y + dy AND q.z = p.z + dz), " + LABELS + ", h AS (SELECT b.*, root AS component FROM b JOIN c USING (id)), own AS (SELECT component, min(f.v) AS v FROM h JOIN o ON d2 = 1 JOIN f ON f.x = h.x + dx AND f.y = h.y + dy AND f.z = h.z + dz GROUP BY component HAVING count(DISTINCT f.v) = 1), edge AS (SELECT DISTINCT component FROM h WHERE x IN (0, 63) OR y IN (0, 63) OR z IN (0, 31)), filled AS (SELECT x, y, z, v FROM f UNION ALL SELECT x, y, z, v FROM h JOIN own USING (component) ANTI JOIN edge USING (component)) "


@query(HOLES + "SELECT * FROM filled", recursive=True)
def fill_holes(spark, sf_dir):
    return cc.fill_holes(_slabs(spark, sf_dir), box(spark), GRID)


@query(HOLES + ", k AS (SELECT v, row_number() OVER (ORDER BY v) AS number FROM filled GROUP BY v HAVING count(*) > 30000) SELECT x, y, z, number AS v FROM filled JOIN k USING (v)", recursive=True)
def fill_and_filter(spark, sf_dir):
    return cc.fill_and_filter(_slabs(spark, sf_dir), box(spark), GRID, 30000 * 64.0)


def _slabs(spark, sf_dir):
    high = scores(spark, sf_dir).where("v >= 46")
    return box(spark).join(high, XYZ, "left_anti").withColumn("v", F.floor(F.col("x") / 16) + 1)


def _two(spark, sf_dir):
    """Two volumes: the lower and the upper half of the labels."""
    vol = labels(spark, sf_dir)
    return vol.where("v <= 20"), vol.where("v > 20")


FACES = "(SELECT a.x, a.y, a.z, a.v, count(*) FILTER (WHERE coalesce(q.v, 0) <> a.v AND " + INSIDE.format("a") + ") AS faces FROM {0} a JOIN o ON d2 = 1 LEFT JOIN {0} q ON q.x = a.x + dx AND q.y = a.y + dy AND q.z = a.z + dz GROUP BY ALL)"
CONTACTS = "+va AS (SELECT * FROM l WHERE v <= 20), vb AS (SELECT * FROM l WHERE v > 20), " + ", ".join(
    f"f{n} AS (SELECT DISTINCT a.x, a.y, a.z, a.v FROM v{n} a JOIN o ON d2 BETWEEN 1 AND 3 LEFT JOIN v{n} b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz WHERE coalesce(b.v, 0) <> a.v AND {INSIDE.format('a')}), n{n} AS (SELECT a.x + dx AS x, a.y + dy AS y, a.z + dz AS z, arg_min(a.v, struct_pack(d2 := d2, v := a.v)) AS v FROM f{n} a JOIN o ON d2 <= 4 WHERE {INSIDE.format('a')} GROUP BY 1, 2, 3), h{n} AS (SELECT * FROM n{n} ANTI JOIN v{n} USING (x, y, z) UNION ALL SELECT * FROM f{n})" for n in "ab"
) + ", b AS MATERIALIZED (SELECT x, y, z, ha.v AS a, hb.v AS b, 4096 * z + 64 * y + x + 1 AS id FROM ha JOIN hb USING (x, y, z)), e AS (SELECT p.id AS u, q.id AS w, p.a, p.b FROM b p JOIN o ON {0} JOIN b q ON q.x = p.x + dx AND q.y = p.y + dy AND q.z = p.z + dz AND q.a = p.a AND q.b = p.b), r AS (SELECT id, a, b, id AS root FROM b UNION SELECT e.w, e.a, e.b, r.root FROM r JOIN e ON r.id = e.u AND r.a = e.a AND r.b = e.b), sites AS MATERIALIZED (SELECT x, y, z, b.a, b.b, min(root) AS component FROM b JOIN r ON b.id = r.id AND b.a = r.a AND b.b = r.b GROUP BY x, y, z, b.a, b.b) "


@query(CONTACTS.format("d2 = 1") + "SELECT * FROM sites", recursive=True)
def contacts_lm(spark, sf_dir):
    return cc.contacts_overlap(*_two(spark, sf_dir), GRID, 4.0)


@query(CONTACTS.format(BY_ANY) + "SELECT * FROM sites", recursive=True)
def contacts_naive(spark, sf_dir):
    return cc.contacts_overlap(*_two(spark, sf_dir), GRID, 4.0, around=True)


@query()
def contacts_em(spark, sf_dir):
    return cc.contacts_sight(*_two(spark, sf_dir), GRID, 4.0)


@query(
    CONTACTS.format(BY_ANY) + ", w AS (SELECT x, y, z, component AS v FROM sites), f AS " + FACES.format("w") + ", own AS (SELECT DISTINCT component AS v, a, b FROM sites), "
    + ", ".join(f"g{n} AS {FACES.format(f'v{n}')}, t{n} AS (SELECT component AS v, sum(faces) * 16.0 AS area FROM sites JOIN g{n} ON g{n}.x = sites.x AND g{n}.y = sites.y AND g{n}.z = sites.z AND g{n}.v = sites.{n} GROUP BY component)" for n in "ab")
    + " SELECT f.v AS id, a, b, count(*) * 64.0 AS volume, sum(faces) * 16.0 AS area, " + ", ".join(f"round(4.0 * sum({c}) / count(*), 6) AS com_{c}, min({c}) * 4.0 AS min_{c}, max({c}) * 4.0 AS max_{c}" for c in "xyz")
    + ", coalesce(any_value(ta.area), 0.0) AS area_a, coalesce(any_value(tb.area), 0.0) AS area_b FROM f JOIN own ON own.v = f.v LEFT JOIN ta ON ta.v = f.v LEFT JOIN tb ON tb.v = f.v GROUP BY f.v, a, b",
    recursive=True,
)
def contact_objects(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    info = objects.contact_info(cc.contacts_overlap(a, b, GRID, 4.0, around=True), a, b, GRID)
    return info.withColumns({f"com_{c}": F.round(f"com_{c}", 6) for c in XYZ})


@query()
def contact_sites_all(spark, sf_dir):
    """All pairs of three volumes by lines of sight, and each volume's objects with each other."""
    a, b = _two(spark, sf_dir)
    return cc.contact_sites({"a": a, "b": b, "high": pointwise.binarize(scores(spark, sf_dir).where("v >= 48"))}, GRID, 4.0, self_pairs=True)


#: Components of two channels as volumes, in place of the two halves of the labels, and halos of one voxel.
_CHANNELS = ", ".join(
    f"b{n} AS MATERIALIZED (SELECT x, y, z, 4096 * z + 64 * y + x + 1 AS id FROM s WHERE {where}), e{n} AS MATERIALIZED (SELECT p.id AS u, q.id AS w FROM b{n} p JOIN o ON d2 = 1 JOIN b{n} q ON q.x = p.x + dx AND q.y = p.y + dy AND q.z = p.z + dz), "
    f"c{n}(id, root) USING KEY (id) AS (SELECT id, id FROM b{n} UNION SELECT e.w, min(r.root) FROM c{n} r JOIN e{n} e ON e.u = r.id JOIN recurring.c{n} k ON k.id = e.w WHERE r.root < k.root GROUP BY e.w), v{n} AS MATERIALIZED (SELECT x, y, z, root AS v FROM b{n} JOIN c{n} USING (id))"
    for n, where in (("a", "v / 50 >= 0.9"), ("b", "1 - v / 50 >= 0.9"))
)


@query("+" + _CHANNELS + CONTACTS.format("d2 = 1").removeprefix("+va AS (SELECT * FROM l WHERE v <= 20), vb AS (SELECT * FROM l WHERE v > 20)").replace("d2 <= 4", "d2 <= 1") + "SELECT 'red_to_green' AS contact, * FROM sites", recursive=True)
def light_contacts(spark, sf_dir):
    """Channels of float predictions."""
    s = scores(spark, sf_dir)
    return cc.light_contacts({"red": s.withColumn("v", F.col("v") / 50), "green": s.withColumn("v", 1 - F.col("v") / 50)}, GRID, {"red": 0.9, "green": 0.9})


# Renumbering


@query("SELECT v, row_number() OVER (ORDER BY v) AS number FROM (SELECT DISTINCT v * 3 AS v FROM l)")
def renumber_dense(spark, sf_dir):
    return renumber.dense_numbers(labels(spark, sf_dir).withColumn("v", F.col("v") * 3))


@query("+c AS (SELECT l.v, s.v AS other, count(*) AS n FROM l JOIN s USING (x, y, z) GROUP BY 1, 2) SELECT v, other AS number FROM c QUALIFY row_number() OVER (PARTITION BY v ORDER BY n DESC, other) = 1")
def renumber_majority(spark, sf_dir):
    return renumber.majority_numbers(labels(spark, sf_dir), scores(spark, sf_dir))


@query("+k AS (SELECT v, row_number() OVER (ORDER BY v) AS number FROM (SELECT DISTINCT v FROM s)) SELECT x, y, z, number AS v FROM s JOIN k USING (v)")
def apply_renumber(spark, sf_dir):
    vol = scores(spark, sf_dir)
    return renumber.apply_numbers(vol, renumber.dense_numbers(vol.select("v")))


@query("SELECT DISTINCT v FROM l")
def distinct_labels(spark, sf_dir):
    return labels(spark, sf_dir).select("v").distinct()


@query("SELECT count(DISTINCT v) AS objects, max(v) AS largest, 'uint8' AS dtype FROM l")
def smallest_type(spark, sf_dir):
    return renumber.smallest_type(labels(spark, sf_dir))


@query("SELECT l.v AS a, s.v AS b, count(*) AS n FROM l JOIN s USING (x, y, z) GROUP BY 1, 2")
def overlap_matrix(spark, sf_dir):
    return objects.overlap_matrix(labels(spark, sf_dir), scores(spark, sf_dir))


# Histograms


@query("+m AS (SELECT x, y, z, v % 3 AS d2, v / 50.0 AS value FROM s WHERE v >= 40), p AS (SELECT f.x, f.y, f.z, f.v, avg(m.value) AS value FROM m JOIN o ON o.d2 <= m.d2 JOIN l f ON f.x = m.x + dx AND f.y = m.y + dy AND f.z = m.z + dz GROUP BY ALL), f AS (SELECT a.x, a.y, a.z, count(*) FILTER (WHERE coalesce(b.v, 0) <> a.v AND " + INSIDE.format("a") + ") AS faces FROM l a JOIN o ON d2 = 1 LEFT JOIN l b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY a.x, a.y, a.z) SELECT bin, round((bin - 1) / 255.0 + 0.5 / 255, 9) AS centre, count(*) * 64.0 AS volume, sum(faces) * 16.0 AS area FROM (SELECT *, CAST(ceil(round(254 * value, 6)) + 1 AS BIGINT) AS bin FROM p) JOIN f USING (x, y, z) GROUP BY bin")
def sheetness_hist(spark, sf_dir):
    medial = scores(spark, sf_dir).where("v >= 40").select(*XYZ, (F.col("v") % 3).alias("d2"), (F.col("v") / 50).alias("value"))
    vol = labels(spark, sf_dir)
    valued = objects.project_to_volume(medial, vol, 2).withColumn("value", F.round(254 * F.col("value"), 6) / 254)
    return objects.value_histogram(valued, vol, GRID).withColumn("centre", F.round("centre", 9))


@query("SELECT b.bin, b.bin * 0.5 AS from_nm, coalesce(n, 0) AS count FROM range(200) b(bin) LEFT JOIN (SELECT CAST(least(floor(2 * sqrt(v) * 4.0 / 0.5), 199) AS BIGINT) AS bin, count(*) AS n FROM s GROUP BY 1) USING (bin)")
def thickness_hist(spark, sf_dir):
    return objects.thickness_histogram(scores(spark, sf_dir).select(*XYZ, F.col("v").alias("d2")), GRID)


@query("SELECT a.v AS id, 16.0 * count(*) FILTER (WHERE b.x IS NULL AND s.x IS NULL) AS other_area, 16.0 * count(*) FILTER (WHERE b.x IS NULL AND s.x IS NOT NULL) AS synapse_area FROM l a JOIN o ON d2 = 1 LEFT JOIN l b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz LEFT JOIN s ON s.x = a.x AND s.y = a.y AND s.z = a.z GROUP BY a.v")
def protrusion_area(spark, sf_dir):
    return objects.protrusion_area(labels(spark, sf_dir), scores(spark, sf_dir), GRID)


# Shape


def _solids(spark, sf_dir):
    """Balls around the objects' voxels."""
    return cut(stencils.stamp_balls(labels(spark, sf_dir), GRID, 2))


@query()
def skeleton(spark, sf_dir):
    return thinning.thin(_solids(spark, sf_dir), GRID)


@query()
def medial_surface(spark, sf_dir):
    return thinning.thin(_solids(spark, sf_dir), GRID, surface=True)


@query()
def planarity(spark, sf_dir):
    return curvature.planarity(_solids(spark, sf_dir), GRID)


@query()
def sphereness_scales(spark, sf_dir):
    """The greatest sphereness over scales."""
    return curvature.planarity(_solids(spark, sf_dir), GRID, measure="sphereness")


def _medial(spark, sf_dir):
    """Solids, and their medial surfaces with depth and planarity."""
    solids = _solids(spark, sf_dir)
    medial = cut(thinning.thin(solids, GRID, surface=True))
    value = curvature.planarity(solids, GRID, at=medial).withColumnRenamed("v", "value")
    valued = medial.join(distance.depth(solids, GRID).select(*XYZ, "d2"), XYZ).join(value, XYZ, "left").select(*XYZ, "v", "d2", F.coalesce("value", F.lit(0.0)).alias("value"))
    return solids, cut(valued)


@query()
def medial_planarity(spark, sf_dir):
    """Each object voxel's mean planarity of its nearest medial voxels, by bins with object volume and surface."""
    solids, medial = _medial(spark, sf_dir)
    return objects.value_histogram(objects.nearest_medial(solids, medial, GRID), solids, GRID)


@query()
def planarity_thickness(spark, sf_dir):
    return objects.planarity_thickness(_medial(spark, sf_dir)[1], GRID)


@query()
def mean_curvature(spark, sf_dir):
    return curvature.surface_curvature(_solids(spark, sf_dir), GRID)


@query()
def gaussian_curvature(spark, sf_dir):
    return curvature.surface_curvature(_solids(spark, sf_dir), GRID, kind="gaussian")


@query()
def curvature_forms(spark, sf_dir):
    """Gaussian and mean curvature of the solids by fundamental forms."""
    return curvature.curvature_forms(_solids(spark, sf_dir), GRID, 3, 7)


GEODESIC = "+m AS (SELECT x, y, z, v, 4096 * z + 64 * y + x + 1 AS id FROM s WHERE v >= 20), sd AS (SELECT id, l.v / 40.0 AS value FROM m JOIN l USING (x, y, z)), e AS MATERIALIZED (SELECT p.id AS u, q.id AS w, d2 + 2 AS cost FROM m p JOIN o ON d2 BETWEEN 1 AND 3 JOIN m q ON q.x = p.x + dx AND q.y = p.y + dy AND q.z = p.z + dz), g(id, d) USING KEY (id) AS (SELECT id, 0 FROM sd UNION SELECT e.w, min(r.d + e.cost) FROM g r JOIN e ON e.u = r.id LEFT JOIN recurring.g k ON k.id = e.w WHERE k.id IS NULL OR r.d + e.cost < k.d GROUP BY e.w)"


@query(GEODESIC + " SELECT x, y, z, CAST(d AS BIGINT) AS d FROM m JOIN g USING (id)", recursive=True)
def geodesic_scores(spark, sf_dir):
    """Chamfer distance from the labels' places within higher scores."""
    return distance.geodesic(labels(spark, sf_dir), scores(spark, sf_dir).where("v >= 20"), GRID)


@query(GEODESIC + ", exact AS (SELECT e.u, e.w FROM e JOIN g a ON a.id = e.u JOIN g b ON b.id = e.w WHERE a.d + e.cost = b.d), p AS (SELECT id, value FROM sd UNION ALL SELECT exact.w, p.value FROM p JOIN exact ON exact.u = p.id), mean AS (SELECT id, round(avg(value), 6) AS value FROM p GROUP BY id) SELECT x, y, z, v, value FROM m JOIN mean USING (id)", recursive=True)
def path_weighted(spark, sf_dir):
    """Values of the labels carried along all shortest paths within higher scores; the SQL lists every path."""
    medial = labels(spark, sf_dir).select(*XYZ, (F.col("v") / 40).alias("value"))
    return objects.path_weighted(scores(spark, sf_dir).where("v >= 20"), medial, GRID).withColumn("value", F.round("value", 6))


@query()
def path_planarity(spark, sf_dir):
    """Each object voxel's planarity over all shortest paths from its medial surface, by bins with object volume and surface."""
    solids, medial = _medial(spark, sf_dir)
    return objects.value_histogram(objects.path_weighted(solids, medial, GRID), solids, GRID)


EDGES = "+b AS (SELECT x, y, z, x // 16 + 1 AS v, 4096 * z + 64 * y + x + 1 AS id FROM s WHERE v >= 40), e AS (SELECT p.v AS obj, p.id AS u, q.id AS v, round(sqrt(d2), 9) AS w FROM b p JOIN o ON d2 BETWEEN 1 AND 3 JOIN b q ON q.x = p.x + dx AND q.y = p.y + dy AND q.z = p.z + dz WHERE p.v = q.v AND p.id < q.id) "


def _strips(spark, sf_dir):
    return scores(spark, sf_dir).where("v >= 40").withColumn("v", F.floor(F.col("x") / 16) + 1)


@query(EDGES + "SELECT * FROM e")
def skeleton_edges(spark, sf_dir):
    return skeletons.skeleton_edges(_strips(spark, sf_dir), GRID).withColumn("w", F.round("w", 9))


@query(EDGES + "SELECT obj, node, count(*) AS degree, CASE WHEN count(*) = 1 THEN 'end' WHEN count(*) >= 3 THEN 'branch' ELSE 'path' END AS kind FROM (SELECT obj, u AS node FROM e UNION ALL SELECT obj, v FROM e) GROUP BY obj, node")
def degree_classes(spark, sf_dir):
    return skeletons.degrees(skeletons.skeleton_edges(_strips(spark, sf_dir), GRID))


def _paths(spark, sf_dir):
    solids = _solids(spark, sf_dir)
    lines = cut(thinning.thin(solids, GRID))
    radius = distance.depth(solids, GRID).select(*XYZ, F.sqrt("d2").alias("radius"))
    vertices = lines.join(radius, XYZ).select(F.col("v").alias("obj"), GRID.index().alias("node"), "radius")
    return skeletons.length_and_thickness(vertices, skeletons.skeleton_edges(lines, GRID), 4.0, 2.0)


@query()
def longest_path(spark, sf_dir):
    return _paths(spark, sf_dir)


@query()
def painted_paths(spark, sf_dir):
    """Longest paths (1) and the rest of the pruned skeletons (2) by object."""
    found = cut(_paths(spark, sf_dir))
    paths = skeletons.paint(found, GRID).withColumn("part", F.lit(1))
    return paths.unionByName(skeletons.paint(found, GRID, "pruned").join(paths, [*XYZ, "v"], "left_anti").withColumn("part", F.lit(2)))


# Compositions


@query("SELECT * FROM l WHERE x BETWEEN 1 AND 62 AND y BETWEEN 1 AND 62 AND z BETWEEN 1 AND 30")
def edge_voxels_removed(spark, sf_dir):
    return pointwise.remove_edge_voxels(labels(spark, sf_dir), GRID)


@query("+out AS (SELECT DISTINCT l.x + dx AS x, l.y + dy AS y, l.z + dz AS z FROM (SELECT * FROM s WHERE v >= 49) l JOIN o ON d2 <= 4) SELECT box.x, box.y, box.z, CAST(1 AS BIGINT) AS v FROM box ANTI JOIN l USING (x, y, z) ANTI JOIN out USING (x, y, z) SEMI JOIN s USING (x, y, z)")
def cell_interior(spark, sf_dir):
    vol = labels(spark, sf_dir)
    outside = distance.edt_bounded(scores(spark, sf_dir).where("v >= 49"), GRID, 4)
    return pointwise.cell_interior(box(spark), vol, outside, scores(spark, sf_dir), 2.0)


@query("+far AS (SELECT DISTINCT s.x + dx AS x, s.y + dy AS y, s.z + dz AS z FROM s JOIN o ON d2 <= 4 WHERE s.v >= 49), " + CC.format("d2 = 1", "(SELECT x, y, z FROM s ANTI JOIN l USING (x, y, z) ANTI JOIN far USING (x, y, z))").removeprefix("+") + "SELECT x, y, z, component AS v FROM b JOIN cc USING (id)", recursive=True)
def cell_volume(spark, sf_dir):
    s = scores(spark, sf_dir)
    return cc.cell_volume(box(spark), labels(spark, sf_dir), s.where("v >= 49"), s, GRID, 2.0)


@query("+f AS (SELECT a.x + dx AS x, a.y + dy AS y, a.z + dz AS z, a.x AS x0, a.y AS y0, a.z AS z0, a.v FROM l a JOIN o ON greatest(abs(dx), abs(dy), abs(dz)) <= 2), m AS (SELECT x0, y0, z0, f.v, avg(f.x - x0) AS mx, avg(f.y - y0) AS my, avg(f.z - z0) AS mz FROM f JOIN l USING (x, y, z) WHERE f.v = l.v GROUP BY x0, y0, z0, f.v) SELECT x0 AS x, y0 AS y, z0 AS z, v, round(CASE WHEN mx * mx + my * my + mz * mz > 0 THEN mx / sqrt(mx * mx + my * my + mz * mz) ELSE 0.0 END, 6) + 0.0 AS nx, round(CASE WHEN mx * mx + my * my + mz * mz > 0 THEN my / sqrt(mx * mx + my * my + mz * mz) ELSE 0.0 END, 6) + 0.0 AS ny, round(CASE WHEN mx * mx + my * my + mz * mz > 0 THEN mz / sqrt(mx * mx + my * my + mz * mz) ELSE 0.0 END, 6) + 0.0 AS nz FROM m")
def surface_normals(spark, sf_dir):
    vol = labels(spark, sf_dir)
    found = stencils.surface_normals(vol, vol, GRID, 2)
    return found.withColumns({f"n{c}": F.round(f"n{c}", 6) + 0.0 for c in XYZ})


@query()
def ribosome_centres(spark, sf_dir):
    return stencils.nonoverlapping(stencils.local_maxima(scores(spark, sf_dir), GRID, 2).where("v >= 45"), GRID, 2.0, 3)


@query(
    CONTACTS.format("d2 = 1") + ", m AS (SELECT x, y, z, CAST(ceil(254 * (v / 50)) + 1 AS BIGINT) AS v FROM s), f AS (SELECT a.x, a.y, a.z, a.v, count(*) FILTER (WHERE q.v IS NULL AND " + INSIDE.format("a") + ") AS faces FROM m a JOIN o ON d2 = 1 LEFT JOIN m q ON q.x = a.x + dx AND q.y = a.y + dy AND q.z = a.z + dz GROUP BY ALL), "
    "met AS (SELECT f.v AS bin, faces, coalesce(l.v, 0) AS organelle, component AS site FROM sites JOIN f USING (x, y, z) LEFT JOIN l USING (x, y, z)) "
    "SELECT 'bin' AS kind, bin AS id, round((bin - 1) / 255 + 0.5 / 255, 9) AS sheetness, sum(faces) * 16.0 AS area FROM met GROUP BY bin HAVING sum(faces) > 0 UNION ALL SELECT 'organelle', organelle, round((avg(bin) - 1) / 255 + 0.5 / 255, 9), NULL FROM met GROUP BY organelle UNION ALL SELECT 'site', site, round((avg(bin) - 1) / 255 + 0.5 / 255, 9), NULL FROM met GROUP BY site",
    recursive=True,
)
def contact_sheetness_tables(spark, sf_dir):
    """Sheetness at contact sites by bin, organelle and site."""
    a, b = _two(spark, sf_dir)
    bins = scores(spark, sf_dir).withColumn("v", objects.unit_bin(F.col("v") / 50))
    found = objects.contact_sheetness_tables(cc.contacts_overlap(a, b, GRID, 4.0), bins, labels(spark, sf_dir), GRID)
    return found.withColumn("sheetness", F.round("sheetness", 9))


@query(CONTACTS.format("d2 = 1") + ", f AS " + FACES.format("l") + " SELECT component, round((avg(CAST(ceil(254 * (s.v / 50)) + 1 AS BIGINT)) - 1) / 255 + 0.5 / 255, 9) AS sheetness, sum(faces) * 16.0 AS area FROM sites JOIN s USING (x, y, z) JOIN f ON f.x = s.x AND f.y = s.y AND f.z = s.z WHERE faces > 0 GROUP BY component", recursive=True)
def contact_sheetness(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    valued = scores(spark, sf_dir).select(*XYZ, (F.col("v") / 50).alias("value"))
    found = objects.contact_sheetness(cc.contacts_overlap(a, b, GRID, 4.0), valued, stencils.exposed_faces(labels(spark, sf_dir), GRID), GRID)
    return found.withColumn("sheetness", F.round("sheetness", 9))
