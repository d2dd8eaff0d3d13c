"""Row-set transformations of images in long form (image, row, col, label, value).

Random choices are drawn by hashes of the image and the seed, once an image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bootstrap import numbered, uniform

INVALID = 100


def drawn(image: str, p: float, seed: int) -> Column:
    """Whether an image is transformed, with probability p."""
    return uniform(seed, F.col(image)) < p


def blank(cells: DataFrame, selected: Column, value: Column | None = None, label: str = "label", column: str = "value") -> DataFrame:
    """Selected cells become invalid and get a fill value (0 by default)."""
    fill = F.lit(0).cast(cells.schema[column].dataType) if value is None else value
    return cells.withColumn(column, F.when(selected, fill).otherwise(F.col(column))).withColumn(label, F.when(selected, F.lit(INVALID)).otherwise(F.col(label)))


def fill_vectors(cells: DataFrame, image: str, selected: Column, how: str = "zero", p: float = 1.0, seed: int = 0, donor: DataFrame | None = None, label: str = "label", column: str = "value") -> DataFrame:
    """Selected cells of an image, which is altered with probability p, become invalid and their vectors are replaced.

    ``zero``: by zeros; ``random``: by numbers drawn for each cell (image, row, col) and place, over their sum;
    ``donor``: by the vector at the same place of ``donor`` (row, col, column), zeros where it has none.
    """
    hit = F.coalesce(selected, F.lit(False)) & drawn(image, p, seed)
    places = F.sequence(F.lit(0), F.size(column) - 1)
    rows = cells
    if how == "zero":
        fill = F.transform(column, lambda x: x * 0)
    elif how == "random":
        numbers = F.transform(places, lambda k: uniform(seed + 1, F.col(image), F.col("row"), F.col("col"), k))
        fill = F.transform(F.array(numbers), lambda v: F.transform(v, lambda x: F.try_divide(x, F.aggregate(v, F.lit(0.0), lambda a, y: a + y))))[0]
    elif how == "donor":
        rows = cells.join(donor.select("row", "col", F.col(column).alias("_donor")), ["row", "col"], "left")
        fill = F.coalesce("_donor", F.transform(column, lambda x: x * 0))
    else:
        raise ValueError(f"no way to fill cells: {how}")
    out = rows.withColumn("_hit", hit).withColumns({column: F.when(F.col("_hit") & (F.size(column) > 0), fill).otherwise(F.col(column)), label: F.when(F.col("_hit"), F.lit(INVALID)).otherwise(F.col(label))})
    return out.select(*cells.columns)


def chosen_label(cells: DataFrame, image: str, valid: Column, seed: int, label: str = "label") -> DataFrame:
    """A random valid label of each image, as ``_chosen``."""
    labels = cells.where(valid).groupBy(image).agg(F.sort_array(F.collect_set(label)).alias("_l"))
    return labels.select(image, F.element_at("_l", (F.floor(uniform(seed, F.col(image)) * F.size("_l")) + 1).cast("int")).alias("_chosen"))


def remove_label(cells: DataFrame, image: str, valid: Column, p: float = 1.0, seed: int = 0, isolate: bool = False) -> DataFrame:
    """A random valid label is blanked, or with ``isolate`` everything else."""
    rows = cells.join(chosen_label(cells, image, valid, seed), image, "left")
    hit = F.col("label") != F.col("_chosen") if isolate else F.col("label") == F.col("_chosen")
    return blank(rows, F.coalesce(hit, F.lit(False)) & drawn(image, p, seed + 1)).drop("_chosen")


def hide_and_seek(cells: DataFrame, image: str, height: int, width: int, hidden: int, patches: int, seed: int = 0) -> DataFrame:
    """``hidden`` draws with replacement from ``patches`` grid patches an image; the drawn ones are blanked."""
    draws = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(hidden)), lambda k: F.floor(uniform(seed, F.col(image), k) * patches)))
    across = F.max(F.floor(F.col("col") / width)).over(Window.partitionBy(image)) + 1
    patch = F.floor(F.col("row") / height) * across + F.floor(F.col("col") / width)
    return blank(cells.withColumn("_p", patch), F.array_contains(draws, F.col("_p"))).drop("_p")


def erase_rectangle(cells: DataFrame, image: str, height: int, width: int, rows: int, cols: int, seed: int = 0) -> DataFrame:
    """A rectangle at a random place of each image is blanked."""
    top = F.floor(uniform(seed, F.col(image), F.lit("r")) * (rows - height + 1))
    left = F.floor(uniform(seed, F.col(image), F.lit("c")) * (cols - width + 1))
    return blank(cells, F.col("row").between(top, top + height - 1) & F.col("col").between(left, left + width - 1))


def erase_region(cells: DataFrame, image: str, region: str, p: float = 1.0, seed: int = 0) -> DataFrame:
    """A random region (a superpixel) of each image is blanked, with probability p."""
    rows = cells.join(chosen_label(cells, image, F.lit(True), seed, region), image, "left")
    return blank(rows, F.coalesce(F.col(region) == F.col("_chosen"), F.lit(False)) & drawn(image, p, seed + 1)).drop("_chosen")


def transplant(cells: DataFrame, image: str, valid: Column, seed: int = 0) -> DataFrame:
    """A random valid label's cells of each image go to the next image, in a random order, at the same places."""
    order = numbered(cells.select(image).distinct(), uniform(seed + 2, F.col(image)), [image], "_i")
    n = order.agg(F.count("*")).scalar()
    target = order.select(F.col(image).alias("_donor"), F.pmod(F.col("_i") - 1, n).alias("_i")).join(order, "_i").drop("_i")
    donors = cells.where(valid).join(chosen_label(cells, image, valid, seed), image).where("label = _chosen")
    donors = donors.select(F.col(image).alias("_donor"), "row", "col", F.col("label").alias("_dl"), F.col("value").alias("_dv")).join(target, "_donor").drop("_donor")
    out = cells.join(donors, [image, "row", "col"], "left")
    return out.select(*[F.coalesce("_dl", "label").alias("label") if c == "label" else F.coalesce("_dv", "value").alias("value") if c == "value" else F.col(c) for c in cells.columns])


def transplant_region(cells: DataFrame, image: str, region: str, seed: int = 0) -> DataFrame:
    """A random region (a superpixel, or a rectangle's number) of each image goes to the next image, in a random order, with its labels."""
    order = numbered(cells.select(image).distinct(), uniform(seed + 2, F.col(image)), [image], "_i")
    n = order.agg(F.count("*")).scalar()
    target = order.select(F.col(image).alias("_donor"), F.pmod(F.col("_i") - 1, n).alias("_i")).join(order, "_i").drop("_i")
    donors = cells.join(chosen_label(cells, image, F.lit(True), seed, region), image).where(F.col(region) == F.col("_chosen"))
    donors = donors.select(F.col(image).alias("_donor"), "row", "col", F.col("label").alias("_dl"), F.col("value").alias("_dv")).join(target, "_donor").drop("_donor")
    out = cells.join(donors, [image, "row", "col"], "left")
    moved = F.col("_dl").isNotNull() | F.col("_dv").isNotNull()
    return out.select(*[F.when(moved, F.col({"label": "_dl", "value": "_dv"}[c])).otherwise(F.col(c)).alias(c) if c in ("label", "value") else F.col(c) for c in cells.columns])


def rectangles(cells: DataFrame, image: str, height: int, width: int, rows: int, cols: int, seed: int = 0, name: str = "region") -> DataFrame:
    """Cells with a region number: 1 in a rectangle at a random place of their image, else null; for ``transplant_region``."""
    top = F.floor(uniform(seed, F.col(image), F.lit("r")) * (rows - height + 1))
    left = F.floor(uniform(seed, F.col(image), F.lit("c")) * (cols - width + 1))
    inside = F.col("row").between(top, top + height - 1) & F.col("col").between(left, left + width - 1)
    return cells.withColumn(name, F.when(inside, 1))


def labels_of_colours(pixels: DataFrame, colours: DataFrame) -> DataFrame:
    """``label`` of pixels (r, g, b) by their colour; a colour without a label is an error."""
    out = pixels.join(colours.select("r", "g", "b", F.col("label").alias("_label")), ["r", "g", "b"], "left")
    unknown = F.raise_error(F.concat_ws(" ", F.lit("no label for the colour"), "r", "g", "b")).cast(colours.schema["label"].dataType)
    return out.select(*pixels.columns, F.coalesce("_label", unknown).alias("label"))


def colours_of_labels(cells: DataFrame, colours: DataFrame) -> DataFrame:
    """``r``, ``g``, ``b`` of cells by their label; black for a label without a colour."""
    out = cells.join(colours.select("label", "r", "g", "b"), "label", "left")
    return out.select(*cells.columns, *[F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in "rgb"])


def jigsaw(cells: DataFrame, image: str, height: int, width: int, seed: int = 0) -> DataFrame:
    """One permutation of all patches of all images of a batch."""
    patch = cells.select(image, F.floor(F.col("row") / height).alias("_r"), F.floor(F.col("col") / width).alias("_c")).distinct()
    order = lambda s: numbered(patch, uniform(s, F.col(image), F.col("_r"), F.col("_c")), [image, "_r", "_c"], "_k")
    here = order(seed)
    there = order(seed + 1).select(F.col(image).alias("_ti"), F.col("_r").alias("_tr"), F.col("_c").alias("_tc"), "_k")
    moves = here.join(there, "_k").drop("_k")
    out = cells.withColumn("_r", F.floor(F.col("row") / height)).withColumn("_c", F.floor(F.col("col") / width)).join(moves, [image, "_r", "_c"])
    moved = {image: F.col("_ti"), "row": F.col("_tr") * height + F.col("row") % height, "col": F.col("_tc") * width + F.col("col") % width}
    return out.select(*[moved[c].alias(c) if c in moved else F.col(c) for c in cells.columns])


def mix_up(images: DataFrame, image: str, columns: list[str], alpha: float, seed: int = 0, labels: list[str] = (), n_classes: int = 0, valid: str | None = None) -> DataFrame:
    """Each image's vectors mixed with those of a shuffled partner.

    ``labels``: columns of class numbers, which become mixed one-hot vectors; with
    ``valid`` a mixed row is valid where both are.
    """
    one_hot = lambda c: F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda k: (F.col(c) == k).cast("double"))
    hot = [one_hot(c).alias(c) for c in labels]
    rows = images.select(*[c for c in images.columns if c not in labels], *hot) if labels else images
    vectors, flags = [*columns, *labels], [valid] if valid else []
    a = numbered(rows, uniform(seed, F.col(image)), [image], "_k")
    b = numbered(rows, uniform(seed + 1, F.col(image)), [image], "_k").select(*[F.col(c).alias(f"_{c}") for c in [*vectors, *flags]], "_k")
    mixed = {c: F.zip_with(c, f"_{c}", lambda x, y: alpha * x + (1 - alpha) * y) for c in vectors} | {c: F.col(c) & F.col(f"_{c}") for c in flags}
    return a.join(b, "_k").select(*[mixed[c].alias(c) if c in mixed else F.col(c) for c in images.columns])


def tiles(cells: DataFrame, height: int, width: int) -> DataFrame:
    """Cells with the tile they lie in and their place in it."""
    down = lambda c, n: F.floor(F.col(c) / n).cast("int")
    return cells.withColumns({"tile_row": down("row", height), "tile_col": down("col", width), "in_row": (F.col("row") % height).cast("int"), "in_col": (F.col("col") % width).cast("int")})


def untiled(tiled: DataFrame, height: int, width: int, rows: int, cols: int) -> DataFrame:
    """The cells of tiles at their places; the padding is cropped."""
    out = tiled.withColumn("row", F.col("tile_row") * height + F.col("in_row")).withColumn("col", F.col("tile_col") * width + F.col("in_col"))
    return out.where((F.col("row") < rows) & (F.col("col") < cols)).drop("tile_row", "tile_col", "in_row", "in_col")


#: Rows of a block of pairs; a task makes some BLOCK * BLOCK pairs of a label.
BLOCK = 2000


def pairs_by_label(df: DataFrame, label: str, first: Column, second: Column, image: str, block: int = BLOCK) -> DataFrame:
    """Images of two conditions that share a label.

    The result grows with the square of a label's rows, so both sides are dealt into blocks by hash, and a
    pair of blocks is one key of the join: no task makes all pairs of a label.
    """
    sizes = df.groupBy(label).agg(F.count_if(first).alias("_a"), F.count_if(second).alias("_b"))
    blocks = sizes.where("_a > 0 and _b > 0").select(label, *[F.ceil(F.col(c) / block).cast("int").alias(c) for c in ("_a", "_b")])
    parts = blocks.agg(F.sum(F.col("_a").cast("long") * F.col("_b"))).first()[0] or 1
    own = lambda n: F.pmod(F.xxhash64(image), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = df.where(first).join(blocks, label).select(label, F.col(image).alias("first"), own("_a").alias("_i"), every("_b").alias("_j"))
    b = df.where(second).join(blocks, label).select(label, F.col(image).alias("second"), own("_b").alias("_j"), every("_a").alias("_i"))
    keys = [label, "_i", "_j"]
    return a.repartition(parts, *keys).join(b.repartition(parts, *keys), keys).select(label, "first", "second")


def oversaturated(spectrum: Column, limit: float = 1.0) -> Column:
    return F.exists(spectrum, lambda x: x > limit)


def lightness(r: Column, g: Column, b: Column) -> Column:
    """L* (0 to 100) of an sRGB colour of numbers from 0 to 255."""

    def linear(c: Column) -> Column:
        x = c.cast("double") / 255
        return F.when(x > 0.04045, F.pow((x + 0.055) / 1.055, F.lit(2.4))).otherwise(x / 12.92)

    # fixed values: the luminance of the primaries, and the constants of L*
    y = 0.212671 * linear(r) + 0.71516 * linear(g) + 0.072169 * linear(b)
    return 116 * F.when(y > 0.008856, F.cbrt(y)).otherwise(7.787 * y + 4.0 / 29) - 16


def specular(r: Column, g: Column, b: Column, limit: float) -> Column:
    """Whether a pixel is a specular highlight: lighter than the limit."""
    return lightness(r, g, b) > limit


def cube_validity(df: DataFrame, image: str, spectrum: str, strict: bool = False) -> DataFrame:
    """Whether an image's spectra are usable: finite, not all zero or negative; strictly, no zero or negative value at all."""
    v = F.col(spectrum)
    unfit = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero, negative = F.forall(v, lambda x: x == 0), F.forall(v, lambda x: x < 0)
    any_zero, any_negative = F.exists(v, lambda x: x == 0), F.exists(v, lambda x: x < 0)
    bad = F.bool_or(unfit) | F.bool_or(zero) | F.bool_or(negative)
    if strict:
        bad = bad | F.bool_or(any_zero) | F.bool_or(any_negative)
    return df.groupBy(image).agg((~bad).alias("valid"))
