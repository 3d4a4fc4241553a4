"""Parameter sets with eager checks; the persisted form is a JSON object without further keys."""

from __future__ import annotations

import dataclasses
import json
import types
import typing

WINDOWS = tuple("rect boxcar hamming hann blackman triang bartlett barthann blackmanharris bohman cosine exponential flattop lanczos nuttall parzen tukey".split())


@dataclasses.dataclass(frozen=True)
class Params:
    def __post_init__(self):
        hints = typing.get_type_hints(type(self))
        for f in dataclasses.fields(self):
            kinds = typing.get_args(hints[f.name]) if isinstance(hints[f.name], types.UnionType) else (hints[f.name],)
            value = getattr(self, f.name)
            fits = any((isinstance(value, k) and not (isinstance(value, bool) and k is not bool)) or (k is float and isinstance(value, int) and not isinstance(value, bool)) for k in kinds)
            if not fits:
                raise TypeError(f"{f.name} must be {' or '.join(k.__name__ for k in kinds)}")
        self.check()

    def check(self) -> None:
        pass

    def to_dict(self) -> dict:
        return dataclasses.asdict(self)

    def to_json(self) -> str:
        return json.dumps(self.to_dict())

    @classmethod
    def schema(cls) -> dict:
        """Field names with their types; nothing else is allowed."""
        return {f.name: str(f.type) for f in dataclasses.fields(cls)}

    @classmethod
    def json_schema(cls) -> dict:
        """The JSON schema (draft 7) of the persisted form."""
        names = {int: "integer", float: "number", bool: "boolean", str: "string", types.NoneType: "null"}
        hints, fields = typing.get_type_hints(cls), dataclasses.fields(cls)
        kinds = {f.name: [names[k] for k in (typing.get_args(hints[f.name]) or (hints[f.name],))] for f in fields}
        return {
            "$schema": "http://json-schema.org/draft-07/schema#",
            "title": cls.__name__,
            "type": "object",
            "properties": {n: {"type": k[0] if len(k) == 1 else k} for n, k in kinds.items()},
            "required": [f.name for f in fields if f.default is dataclasses.MISSING],
            "additionalProperties": False,
        }

    @classmethod
    def from_dict(cls, values: dict):
        unknown = set(values) - {f.name for f in dataclasses.fields(cls)}
        if unknown:
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        return cls(**values)

    @classmethod
    def from_json(cls, text: str):
        return cls.from_dict(json.loads(text))


@dataclasses.dataclass(frozen=True)
class SegmentationParams(Params):
    n_perseg: int = 512
    n_overlap: int = 256
    extend: bool = True
    pad: bool = True

    def check(self) -> None:
        if not 0 < self.n_overlap < self.n_perseg:
            raise ValueError("0 < n_overlap < n_perseg is needed")

    @property
    def step(self) -> int:
        return self.n_perseg - self.n_overlap

    @property
    def ext(self) -> int:
        return self.n_perseg // 2 if self.extend else 0


@dataclasses.dataclass(frozen=True)
class DftParams(Params):
    fps: int
    window: str = "hamming"
    n_fft: int | types.NoneType = None

    def check(self) -> None:
        if self.window not in WINDOWS:
            raise ValueError(f"unknown window {self.window!r}")
        if self.fps < 1 or (self.n_fft is not None and self.n_fft < 1):
            raise ValueError("fps and n_fft must be positive")


@dataclasses.dataclass(frozen=True)
class StftParams(DftParams):
    n_perseg: int = 512
    n_overlap: int = 256
    extend: bool = True
    pad: bool = True

    def check(self) -> None:
        super().check()
        self.segmentation()

    def segmentation(self) -> SegmentationParams:
        return SegmentationParams(self.n_perseg, self.n_overlap, self.extend, self.pad)


@dataclasses.dataclass(frozen=True)
class CorrDimParams(Params):
    delay: int
    m_dim: int
    n_bins: int = 1000
    scaling_size: int = 10

    def check(self) -> None:
        if min(self.delay, self.m_dim, self.n_bins, self.scaling_size) < 1:
            raise ValueError("all parameters must be positive")


@dataclasses.dataclass(frozen=True)
class CorrGramParams(Params):
    wlen: int
    n_delay: int
    total: bool = True

    def check(self) -> None:
        if self.wlen < 1 or self.n_delay < 1:
            raise ValueError("wlen and n_delay must be positive")


@dataclasses.dataclass(frozen=True)
class PeakPickingParams(Params):
    n_before: int = 10
    n_after: int = 10
    alpha: float = 0.1
    delta: float = 0.1

    def check(self) -> None:
        if self.n_before < 0 or self.n_after < 0 or not 0 <= self.alpha <= 1:
            raise ValueError("window sizes can't be negative and alpha lies in [0, 1]")
