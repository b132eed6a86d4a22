"""Pixels of images: decoding (with any installed codec), perceptual hashes, letterboxing and masks, in Arrow batches.

Decoding needs Pillow, which is optional; the kernels below it are NumPy and need nothing. Feature extraction is
one function from pixels to descriptors that the caller supplies, used alike for training and for queries.
"""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normlens.operators.geometry import DEVIATION, MEAN


def decode(content: bytes | None, mode: str = "RGB") -> np.ndarray | None:
    """Height x width (x channels) bytes; None for what is not an image, whatever is wrong with it. Netpbm (P5, P6) needs no codec."""
    if not content:
        return None
    if content[:2] in (b"P5", b"P6"):
        return _netpbm(content, mode)
    try:
        from PIL import Image
    except ImportError as error:
        raise RuntimeError("decoding this format needs Pillow") from error
    try:
        return np.asarray(Image.open(io.BytesIO(content)).convert(mode))
    except Exception:  # noqa: BLE001 - codecs raise all kinds of errors; a broken file is a row, not the job's end
        return None


#: Width, height and greatest value, between white space and comments, and the one byte of white space before the pixels.
NETPBM = re.compile(rb"P([56])" + rb"(?:\s|#[^\n\r]*[\n\r])+(\d{1,9})" * 3 + rb"(?:#[^\n\r]*)?\s")


def _netpbm(content: bytes, mode: str) -> np.ndarray | None:
    head = NETPBM.match(content)
    if not head:
        return None
    channels = 1 if head[1] == b"5" else 3
    width, height, top = (int(x) for x in head.groups()[1:])
    if not width or not height or not 0 < top < 1 << 16:
        return None
    kind = np.dtype(np.uint8 if top < 256 else ">u2")
    n = width * height * channels
    if len(content) - head.end() < n * kind.itemsize:
        return None
    pixels = np.frombuffer(content, dtype=kind, count=n, offset=head.end()).reshape(height, width, channels)
    if top != 255:
        pixels = np.rint(np.minimum(pixels, top) * (255.0 / top)).astype(np.uint8)
    if mode == "L":
        return pixels[:, :, 0] if channels == 1 else np.rint(pixels @ [0.299, 0.587, 0.114]).astype(np.uint8)
    return np.broadcast_to(pixels, (height, width, 3)) if channels == 1 else pixels


def bilinear(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Floats enlarged or shrunk with aligned pixel centres and repeated borders, two neighbours an axis."""
    out = pixels.astype(np.float64)
    for axis, size in ((0, height), (1, width)):
        n = out.shape[axis]
        at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        share = (at - low).reshape([-1 if a == axis else 1 for a in range(out.ndim)])
        out = np.take(out, low, axis) * (1 - share) + np.take(out, np.minimum(low + 1, n - 1), axis) * share
    return out


def triangle(x: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, 1 - np.abs(x))


def lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


@lru_cache(maxsize=256)
def resample_weights(n: int, size: int, kernel: Callable[[np.ndarray], np.ndarray], reach: float) -> np.ndarray:
    """size x n weights: the kernel around each target pixel's centre, as wide as the target pixel where it shrinks.

    They are singles if all are whole 1024ths, as of a triangle that enlarges to a power of two: sums over bytes are exact then."""
    wide = max(1.0, n / size)
    centre = (np.arange(size) + 0.5) * n / size
    first, last = np.maximum(0, np.floor(centre - reach * wide + 0.5)), np.minimum(n, np.floor(centre + reach * wide + 0.5))
    source = np.arange(n)
    weights = kernel((source + 0.5 - centre[:, None]) / wide)
    weights[(source < first[:, None]) | (source >= last[:, None])] = 0
    weights /= weights.sum(axis=1, keepdims=True)
    return weights.astype(np.float32) if (weights * 1024 % 1 == 0).all() and np.abs(weights).sum(axis=1).max() <= 2 else weights


#: Added before the floor: halves go up, and so does what the order of a sum leaves below one.
HALF = 0.5 + 0.5e-9


def distinct_layers(pixels: np.ndarray) -> list[np.ndarray]:
    """The channels of an image, or one of them if all are equal: a grey image is worked on once."""
    layers = [pixels[:, :, c] for c in range(pixels.shape[2])]
    return layers[:1] if not pixels.strides[2] or all(np.array_equal(layers[0], x) for x in layers[1:]) else layers


def resized(pixels: np.ndarray, height: int, width: int, kernel: Callable[[np.ndarray], np.ndarray] = triangle, reach: float = 1) -> np.ndarray:
    """Bytes resized as imaging libraries do: filters widen where the image shrinks; first rows, then columns, each to whole bytes."""
    if pixels.ndim == 3:
        made = [resized(x, height, width, kernel, reach) for x in distinct_layers(pixels)]
        return np.stack(made * (pixels.shape[2] // len(made)), axis=2)
    return resized_layer(pixels, height, width, kernel, reach).astype(np.uint8)


def resized_layer(pixels: np.ndarray, height: int, width: int, kernel: Callable[[np.ndarray], np.ndarray] = triangle, reach: float = 1) -> np.ndarray:
    """``resized`` of one channel, as floats."""

    def whole(x: np.ndarray) -> np.ndarray:
        x += HALF
        np.floor(x, out=x)
        return np.clip(x, 0, 255, out=x) if reach > 1 else x  # a triangle has no negative weights

    out = pixels
    if width != out.shape[1]:
        weights = resample_weights(out.shape[1], width, kernel, reach)
        out = whole(out.astype(weights.dtype) @ weights.T)
    if height != out.shape[0]:
        weights = resample_weights(out.shape[0], height, kernel, reach)
        out = whole(weights @ out.astype(weights.dtype))
    return out


def nearest(mask: np.ndarray, height: int, width: int) -> np.ndarray:
    rows = np.floor((np.arange(height) + 0.5) * mask.shape[0] / height).astype(int)
    columns = np.floor((np.arange(width) + 0.5) * mask.shape[1] / width).astype(int)
    return mask[rows][:, columns]


def fitted(height: int, width: int, target: int) -> tuple[int, int, int, int]:
    """Height, width, top and left of an image resized to fit into a square and centred there."""
    scale = min(target / width, target / height)
    h, w = max(1, round(height * scale)), max(1, round(width * scale))
    return h, w, (target - h) // 2, (target - w) // 2


#: The mean colour in whole bytes.
BORDER = np.rint(255 * np.array(MEAN))


def letterboxed_bytes(pixels: np.ndarray, target: int = 256) -> np.ndarray:
    """Target x target x 3 bytes: the image resized to fit, on a border of the mean colour in whole bytes."""
    h, w, top, left = fitted(*pixels.shape[:2], target)
    out = np.empty((target, target, 3), dtype=np.uint8)
    out[:] = BORDER
    out[top : top + h, left : left + w] = resized(pixels, h, w)
    return out


#: What each byte is in each channel, normalised.
NORMALISED = (np.arange(256)[:, None] / 255 - MEAN) / DEVIATION


def normalised(pixels: np.ndarray) -> np.ndarray:
    out = np.empty(pixels.shape)
    for c in range(3):
        out[..., c] = NORMALISED[:, c].take(pixels[..., c])
    return out


def letterboxed(pixels: np.ndarray, target: int = 256) -> np.ndarray:
    """Target x target x 3 floats, normalised; the border too."""
    return normalised(letterboxed_bytes(pixels, target))


def centre_cropped(pixels: np.ndarray, shorter: int = 256, crop: int = 224, mask: bool = False) -> np.ndarray:
    """The centred square after the shorter side is resized; a mask takes the nearest pixel, above 127 counts."""
    height, width = pixels.shape[:2]
    h, w = (int(shorter * height / width), shorter) if width <= height else (shorter, int(shorter * width / height))
    out = (nearest(pixels, h, w) > 127).astype(np.uint8) if mask else resized(pixels, h, w)
    top, left = round((h - crop) / 2), round((w - crop) / 2)
    return out[top : top + crop, left : left + crop]


def letterboxed_mask(mask: np.ndarray, target: int = 256) -> np.ndarray:
    """Target x target 0/1 values: nearest resize, border 0, above 127 counts."""
    h, w, top, left = fitted(*mask.shape, target)
    out = np.zeros((target, target), dtype=np.uint8)
    out[top : top + h, left : left + w] = nearest(mask, h, w) > 127
    return out


def perceptual_hash(gray: np.ndarray, size: int = 8, factor: int = 4) -> int:
    """64-bit hash: which of the lowest cosine coefficients of the image, shrunk with a Lanczos filter, lie above their median.

    Coefficients are compared at six decimals: those of a plain image are 0, not what the order of a sum leaves."""
    n = size * factor
    small = resized(gray, n, n, lanczos, 3).astype(np.float64)
    k = np.arange(n)
    basis = np.cos(np.pi * np.outer(k, 2 * k + 1) / (2 * n))
    low = np.round((basis @ small @ basis.T)[:size, :size].reshape(-1), 6)
    bits = low > np.median(low)
    return int(np.packbits(bits).view(">i8")[0])


def attributes(images: DataFrame) -> DataFrame:
    """path, width, height, corrupt of each image (content is read); corrupt ones have null sizes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [decode(c and bytes(c)) for c in batch["content"]]
            size = [(None, None) if p is None else (p.shape[1], p.shape[0]) for p in found]
            yield pd.DataFrame({"path": batch["path"], "width": pd.array([w for w, _ in size], "Int32"), "height": pd.array([h for _, h in size], "Int32"), "corrupt": [p is None for p in found]})

    return images.select("path", "content").mapInPandas(run, "path string, width int, height int, corrupt boolean")


def fingerprints(images: DataFrame) -> DataFrame:
    """id (the path) and fingerprint of each readable image; others are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(p, decode(c and bytes(c), "L")) for p, c in zip(batch["path"], batch["content"], strict=True)]
            rows = [(p, perceptual_hash(g)) for p, g in found if g is not None]
            yield pd.DataFrame(rows, columns=["id", "fingerprint"])

    return images.select("path", "content").mapInPandas(run, "id string, fingerprint long")


def cell_statistics(batch: np.ndarray, grid: int = 32) -> np.ndarray:
    """n x grid x grid x 12 descriptors without any learned part: each cell's mean and deviation of every channel, and
    the mean size of its steps across and down. One deterministic extractor; a network's function takes its place."""
    n, side = batch.shape[0], batch.shape[1] // grid
    out = np.empty((n, grid, grid, 12))
    for image, made in zip(batch, out, strict=True):  # one by one: an image stays in the processor's memory

        def means(x: np.ndarray) -> np.ndarray:
            """Of each cell and channel; rows are summed first, which lie side by side."""
            return x.reshape(grid, side, grid * side * 3).sum(axis=1).reshape(grid, grid, side, 3).sum(axis=2) / (side * side)

        mean = means(image)
        apart = image.reshape(grid, side, grid, side, 3) - mean[:, None, :, None]
        np.multiply(apart, apart, out=apart)
        across, down = np.zeros(image.shape), np.zeros(image.shape)  # the last step of a line is to itself
        np.abs(np.subtract(image[:, 1:], image[:, :-1], out=across[:, :-1]), out=across[:, :-1])
        np.abs(np.subtract(image[1:], image[:-1], out=down[:-1]), out=down[:-1])
        made[:] = np.concatenate([mean, np.sqrt(means(apart)), means(across), means(down)], axis=-1)
    return out


@lru_cache(maxsize=512)
def cell_places(start: int, n: int, grid: int, side: int, kind: type = np.float64) -> np.ndarray:
    """grid x n: 1 where the line ``start`` + j lies in cell i."""
    out = np.zeros((grid, n), dtype=kind)
    out[np.arange(start, start + n) // side, np.arange(n)] = 1
    return out


@lru_cache(maxsize=1024)
def covered(height: int, width: int, grid: int, target: int) -> np.ndarray:
    """grid x grid: the pixels of each cell that the letterboxed image covers."""
    h, w, top, left = fitted(height, width, target)
    return np.outer(*(cell_places(start, n, grid, target // grid).sum(axis=1) for start, n in ((top, h), (left, w))))


@dataclass(frozen=True)
class CellStatistics:
    """``cell_statistics`` on a grid, for ``extract_patches``. On a batch it takes normalised floats; ``of_images`` gives the same from
    bytes: cells are summed in whole numbers, a grey image's channels at once, and the border enters by counts and its edges."""

    grid: int = 32

    def __call__(self, batch: np.ndarray) -> np.ndarray:
        return cell_statistics(batch, self.grid)

    def of_images(self, images: list[np.ndarray], target: int = 256) -> np.ndarray:
        """n x grid x grid x 12 of the images as they are letterboxed."""
        n, byte = (target // self.grid) ** 2, BORDER[:, None, None]
        sums = np.stack([self._sums(p, target) for p in images])
        border = n - np.stack([covered(*p.shape[:2], self.grid, target) for p in images])[:, None]
        sums[:, 0] += border * byte
        sums[:, 1] += border * byte**2
        sums[:, 1] = np.sqrt(n * sums[:, 1] - sums[:, 0] ** 2)
        out = sums.transpose(0, 3, 4, 1, 2) / (n * 255)
        out[..., 0, :] -= MEAN
        return (out / DEVIATION).reshape(len(images), self.grid, self.grid, 12)

    def _sums(self, pixels: np.ndarray, target: int) -> np.ndarray:
        """4 x 3 x grid x grid: bytes and their squares without the border, steps across and down with it; of each channel."""
        grid, side = self.grid, target // self.grid
        h, w, top, left = fitted(*pixels.shape[:2], target)
        exact = np.float32 if side * 255**2 < 1 << 24 else np.float64  # sums over a cell's rows are whole numbers that it holds
        rows, columns = cell_places(top, h, grid, side, exact), cell_places(left, w, grid, side).T
        out = np.empty((4, 3, grid, grid))
        for c, layer in enumerate(layers := distinct_layers(pixels)):
            of = slice(c, c + 1 if len(layers) > 1 else None)
            x = resized_layer(layer, h, w).astype(exact, copy=False)
            across, down = x[:, 1:] - x[:, :-1], x[1:] - x[:-1]
            out[0, of] = (rows @ x) @ columns
            out[1, of] = (rows @ (x * x)) @ columns
            out[2, of] = (rows @ np.abs(across, out=across)) @ columns[:-1]
            out[3, of] = (rows[:, :-1] @ np.abs(down, out=down)) @ columns
            # A step is its first pixel's: one from the border belongs to the border's last line.
            byte = BORDER[of, None]
            for at, edge in ((left - 1, x[:, 0]), (left + w - 1, x[:, -1])):
                if 0 <= at < target - 1:
                    out[2, of, :, at // side] += np.abs(edge - byte) @ rows.T
            for at, edge in ((top - 1, x[0]), (top + h - 1, x[-1])):
                if 0 <= at < target - 1:
                    out[3, of, at // side] += np.abs(edge - byte) @ columns
        return out


def valid_share(height: int, width: int, grid: int, target: int = 256) -> np.ndarray:
    """grid x grid: the share of each cell that the letterboxed image covers."""
    return covered(height, width, grid, target) / (target // grid) ** 2


#: Rows of images whose patches go out together.
ROWS_OUT = 256


def extract_patches(images: DataFrame, features: Callable[[np.ndarray], np.ndarray], grid: int = 32, target: int = 256, least: float = 0.5, batch: int = 16, key: str = "path") -> DataFrame:
    """key, patch, v of each valid cell, and key, error of what gave none (patch and v null): "undecodable" or the failure.

    ``features`` maps a batch of letterboxed images, n x target x target x 3, to n x grid x grid x dims descriptors. If it has
    ``of_images``, as ``CellStatistics``, it is given the images as they were decoded. It is not asked for images without a valid cell."""
    kind = images.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, patch int, v array<double>, error string"
    of_images = getattr(features, "of_images", None) or (lambda good, target: features(np.stack([letterboxed(p, target) for p in good])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches:
            for at in range(0, frame.num_rows, ROWS_OUT):
                some = frame.slice(at, ROWS_OUT)
                rows, patches, vectors, bad, held = [], [], [], [], []
                for k in range(some.num_rows):
                    pixels = decode(some.column(1)[k].as_py())
                    cells = () if pixels is None else np.flatnonzero(valid_share(*pixels.shape[:2], grid, target).reshape(-1) >= least)
                    if len(cells):
                        held.append((k, pixels, cells))
                    else:
                        bad.append((k, "undecodable" if pixels is None else "failed: no valid patch"))
                    if held and (len(held) == batch or k == some.num_rows - 1):
                        try:
                            described = of_images([p for _, p, _ in held], target).reshape(len(held), grid * grid, -1)
                            rows += [np.full(len(cells), j) for j, _, cells in held]
                            patches += [cells for _, _, cells in held]
                            vectors += [found[cells].astype(np.float64) for found, (_, _, cells) in zip(described, held, strict=True)]
                        except Exception as error:  # noqa: BLE001 - the answer to these requests, not the job's end
                            bad += [(j, f"failed: {error}") for j, _, _ in held]
                        held = []
                none, n = [None] * len(bad), sum(map(len, patches))
                joined = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
                flat = joined([x.ravel() for x in vectors], np.float64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (len(flat) // max(n, 1))), pa.array(flat))
                columns = [
                    some.column(0).take(pa.array(np.append(joined(rows, np.int64), [k for k, _ in bad]).astype(np.int64))),
                    pa.concat_arrays([pa.array(joined(patches, np.int64).astype(np.int32)), pa.array(none, pa.int32())]),
                    pa.concat_arrays([lists, pa.array(none, pa.list_(pa.float64())).cast(lists.type)]),
                    pa.array([None] * n + [e for _, e in bad], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "patch", "v", "error"])

    return images.select(key, "content").mapInArrow(run, schema)


def load_masks(manifest: DataFrame, files: DataFrame, missing: str = "none") -> DataFrame:
    """image_path, width, height, mask (bytes of 0 and 1, row by row) of the manifest's defect images.

    ``files`` has path and content. A mask that is not there gives nulls ("none"), ends the job ("raise") or leaves the
    image out ("skip"); so does one that cannot be decoded."""
    if missing not in ("none", "raise", "skip"):
        raise ValueError(f"missing is none, raise or skip, not {missing}")
    wanted = manifest.where("label = 1").select("image_path", "mask_path")
    # By a merge join: Spark guesses a computed binary column at 100 bytes a row, and would broadcast all contents.
    rows = wanted.join(files.select(F.col("path").alias("mask_path"), "content").hint("merge"), "mask_path", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mask = None if content is None else decode(content, "L")
                if mask is not None:
                    out.append((path, mask.shape[1], mask.shape[0], (mask > 127).astype(np.uint8).tobytes()))
                elif missing == "raise":
                    raise ValueError(f"no mask for {path}")
                elif missing == "none":
                    out.append((path, None, None, None))
            columns = zip(*out, strict=True) if out else [()] * 4
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["image_path", "width", "height", "mask"])

    return rows.select("image_path", "content").mapInArrow(run, "image_path string, width int, height int, mask binary")


def _areas(pixels: np.ndarray, target: int, shorter: int, crop: int) -> tuple[int, int, int]:
    """Defect pixels of a mask of 0 and 255, as it is, letterboxed, and cropped."""
    kept = (letterboxed_mask(pixels, target), centre_cropped(pixels, shorter, crop, mask=True))
    return (int(np.count_nonzero(pixels)), *(int(k.sum()) for k in kept))


def _areas_batch(keys: pa.Array, areas: list, name: str) -> pa.RecordBatch:
    columns = zip(*areas, strict=True) if areas else [()] * 3
    return pa.RecordBatch.from_arrays([keys, *(pa.array(c, pa.int64()) for c in columns)], names=[name, *AREAS])


def mask_areas(masks: DataFrame, target: int = 256, shorter: int = 256, crop: int = 224) -> DataFrame:
    """image_path, original_pixels, letterboxed_pixels, cropped_pixels of ``load_masks``: defect pixels before and after both ways to resize.

    The letterbox keeps all of the image; the crop takes the centre after the shorter side is resized. An image without a
    mask has nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at in range(batch.num_rows):  # one mask at a time: a batch of them is large, and need not lie here twice
                width, height, mask = (batch.column(i)[at].as_py() for i in (1, 2, 3))
                pixels = None if mask is None else np.frombuffer(mask, dtype=np.uint8).reshape(height, width) * np.uint8(255)
                out.append((None, None, None) if pixels is None else _areas(pixels, target, shorter, crop))
            yield _areas_batch(batch.column(0), out, "image_path")

    return masks.select("image_path", "width", "height", "mask").mapInArrow(run, "image_path string, " + AREAS_SCHEMA)


def file_areas(manifest: DataFrame, files: DataFrame, target: int = 256, shorter: int = 256, crop: int = 224) -> DataFrame:
    """``mask_areas`` of ``load_masks(manifest, files)``, but files are counted where they are read: what is exchanged is three numbers
    a file, never its content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at in range(batch.num_rows):
                content = batch.column(1)[at].as_py()
                mask = None if content is None else decode(content, "L")
                out.append((None, None, None) if mask is None else _areas((mask > 127) * np.uint8(255), target, shorter, crop))
            yield _areas_batch(batch.column(0), out, "mask_path")

    counted = files.select(F.col("path").alias("mask_path"), "content").mapInArrow(run, "mask_path string, " + AREAS_SCHEMA)
    return manifest.where("label = 1").select("image_path", "mask_path").join(counted.hint("merge"), "mask_path", "left").select("image_path", *AREAS)


AREAS = ("original_pixels", "letterboxed_pixels", "cropped_pixels")
AREAS_SCHEMA = ", ".join(f"{c} long" for c in AREAS)
