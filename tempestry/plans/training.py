"""Training inputs: storm packages, feature sequences and windows with patches."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempestry.functions.clock import from_micros, micros
from tempestry.operators import features, ordered, patches
from tempestry.sources.tiles import corner_tiles, tile_placeholders

SOURCES = ("best_track", "arrays")
FIELD_CHANNELS = ["u10", "v10", "msl", "sst"]
#: Tile cells of a fix that each of its field cells is compared with; where there are more, they are keys of the join.
FEW_TILES = 16
#: Columns of tiles that are no channels.
TILE_KEYS = ["storm_id", "time", "latitude", "longitude", "row", "col"]


@dataclass
class StormPackage:
    """Tables of one set of storms, all keyed by ``storm_id``."""

    track: DataFrame
    grid: DataFrame | None = None
    tiles: DataFrame | None = None


def storm_package(
    archives: dict[str, DataFrame],
    source: str = "best_track",
    grid: DataFrame | None = None,
    include_tiles: bool = False,
    storm_ids: list[str] | None = None,
    patch_size: float = patches.DEFAULT_PATCH,
    variables: list[str] | None = None,
    tile_sources: list[str] | None = None,
) -> StormPackage:
    """Tracks of a source with the grid cells and tiles around them.

    Without a grid the package simply has none, as when its data is not there.
    """
    if source not in archives:
        raise ValueError(f"unknown source: {source}")
    track = archives[source]
    if storm_ids:
        track = track.filter(F.col("storm_id").isin(storm_ids))
    cube = None
    if grid is not None:
        cube = patches.storm_cube_extract(grid, track, patch_size, variables)
    tiles = tile_placeholders(track, patch_size, tile_sources) if include_tiles else None
    return StormPackage(track, cube, tiles)


def training_sequences(
    tracks: DataFrame,
    sequence_length: int = 8,
    forecast_length: int = 4,
    order: str = "timestamp",
    block_rows: int = ordered.BLOCK_ROWS,
    numbered: str | None = None,
) -> DataFrame:
    """Features, normalised over all storms, cut into windows."""
    points = ordered.with_points(tracks, ["storm_id"], order, numbered)
    made = features.track_features(points, order=order, block_rows=block_rows, numbered=ordered.NUMBER)
    scaled = features.track_zscore(made)
    return features.sliding_sequences(
        scaled, sequence_length, forecast_length, order=order, block_rows=block_rows, numbered=ordered.NUMBER
    )


def tile_cells(images: DataFrame, rows: int = 2, cols: int = 2) -> DataFrame:
    """Row and column of the tile cell that each cell of an image lies in, tiles having ``rows`` x ``cols`` cells."""
    return images.withColumns(
        {
            "tile_row": F.floor(F.col("row") * rows / F.col("n_rows")).cast("int"),
            "tile_col": F.floor(F.col("col") * cols / F.col("n_cols")).cast("int"),
        }
    )


def patch_channels(
    tracks: DataFrame,
    grid: DataFrame,
    step_hours: int,
    patch_size: float = patches.DEFAULT_PATCH,
    channels: list[str] | None = None,
    fixes: DataFrame | None = None,
    tiles: DataFrame | None = None,
    tile_shape: tuple[int, int] = (2, 2),
    coordinates: DataFrame | None = None,
) -> DataFrame:
    """Per fix and cell of its patch: tile channels, then field channels.

    Rows count from the north and columns from the west edge of the patch, over the dateline too.  Every field
    cell takes the tile cell that covers its part of the patch.
    Both sides are matched by the fix's own timestamp, not by their place in time.
    ``fixes`` limits the work to some fixes of the tracks.  ``tiles`` gives images by (storm_id, time, row, col)
    with one column per channel; without it, tiles are the zero-filled placeholders.
    """
    on = ["storm_id", "timestamp", "row", "col"]
    chosen = channels or FIELD_CHANNELS
    wanted = tracks if fixes is None else fixes
    cells = patches.patch_images(grid, wanted, patch_size, chosen, step_hours, coordinates)
    quarter = ["storm_id", "timestamp", "tile_row", "tile_col"]
    numbered = tile_cells(cells, *tile_shape)
    present = [c for c in chosen if c in grid.columns]
    fields = patches.as_channels(numbered, present, [*on, "tile_row", "tile_col"])
    if tiles is None:
        tiles = corner_tiles(tracks, patch_size, fixes=fixes)
    sources = [c for c in tiles.columns if c not in TILE_KEYS]
    tiles = tiles.withColumnsRenamed({"time": "timestamp", "row": "tile_row", "col": "tile_col"})
    if tile_shape[0] * tile_shape[1] <= FEW_TILES:
        tiles = tiles.where(F.col("tile_row").between(0, tile_shape[0] - 1) & F.col("tile_col").between(0, tile_shape[1] - 1))
    # by fix alone, so that a later join of fixes needs no other exchange and sort of all cells
    keys = 2 if tile_shape[0] * tile_shape[1] <= FEW_TILES else 4
    return patches.channel_concat(patches.as_channels(tiles, sources, quarter), fields, quarter[:keys], on, quarter[keys:])


def aligned_windows_patches(
    tracks: DataFrame,
    grid: DataFrame,
    step_hours: int,
    sequence_length: int = 1,
    forecast_length: int = 1,
    patch_size: float = patches.DEFAULT_PATCH,
    order: str = "timestamp",
    block_rows: int = ordered.BLOCK_ROWS,
    tiles: DataFrame | None = None,
    tile_shape: tuple[int, int] = (2, 2),
    numbered: str | None = None,
    coordinates: DataFrame | None = None,
) -> DataFrame:
    """Shared windows with the channels of each input fix.

    One row per (window index, storm, input position, cell).  A position whose fix
    has no cells stays as one row with NULL channels, and ``complete`` tells whether
    every position of the window has some; it is known per fix, before windows are cut.  Windows refer to
    fixes by timestamp, so channels join on (storm, timestamp) and no image is
    copied before the join.  ``coordinates`` names a table (time, latitude, longitude) of the grid's cells, if there is
    one that is quicker to read than the grid.
    """
    kept = features.shared_fixes(tracks, sequence_length, forecast_length, order, numbered)
    cells = grid if coordinates is None else coordinates
    shown = patches.fixes_with_cells(cells, kept, patch_size, step_hours).withColumn("_tempestry_shown", F.lit(1.0))
    stamped = kept.withColumn("_tempestry_stamp", micros(F.col(order)).cast("double")).join(shown, ["storm_id", "timestamp"], "left")
    windows = features.sliding_sequences(
        stamped, sequence_length, forecast_length, [*features.STATE_FEATURES, "_tempestry_stamp", "_tempestry_shown"], order, block_rows, ordered.NUMBER
    )
    complete = F.forall("inputs", lambda fix: F.element_at(fix, -1).isNotNull())
    steps = windows.select("storm_id", "window_index", complete.alias("complete"), F.posexplode("inputs").alias("position", "_tempestry_in"))
    steps = steps.withColumn(
        "timestamp",
        from_micros(F.element_at("_tempestry_in", -2).cast("long")),
    ).withColumn("state", F.slice("_tempestry_in", 1, len(features.STATE_FEATURES)))
    images = patch_channels(tracks, grid, step_hours, patch_size, fixes=kept, tiles=tiles, tile_shape=tile_shape, coordinates=coordinates)
    joined = steps.join(images, ["storm_id", "timestamp"], "left")
    return joined.select("storm_id", "timestamp", "window_index", "position", "state", "complete", "row", "col", "channels")
