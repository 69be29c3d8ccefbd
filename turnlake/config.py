"""Constants and settings of the engine."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values of the audio and frame grid.
SAMPLE_RATE = 16_000
WINDOW_SECONDS = 10.0
FRAME_DURATION = 0.0619375
FRAME_STEP = 0.016875
FRAMES_PER_WINDOW = 589
MIN_SPEAKER_ACTIVITY = 10.0
LOCAL_SPEAKERS = 3
MAX_OVERLAP = 2
PLDA_DIM = 128
INACTIVE = -2

#: Window step in seconds by execution mode.
STEPS = {"cpu": 1.0, "coreml": 0.96, "coreml-fast": 2.0, "cuda": 1.0, "cuda-fast": 2.0}


def window_step(mode: str) -> float:
    try:
        return STEPS[mode]
    except KeyError:
        raise ValueError(f"unknown mode {mode!r}; one of {sorted(STEPS)}") from None


@dataclass(frozen=True)
class BinarizeConfig:
    onset: float = 0.5
    offset: float = 0.5
    min_on: int = 0
    min_off: int = 0
    pad_onset: int = 0
    pad_offset: int = 0


@dataclass(frozen=True)
class VbxConfig:
    fa: float = 0.07
    fb: float = 0.8
    max_iters: int = 20
    epsilon: float = 1e-4
    init_smoothing: float = 7.0


@dataclass(frozen=True)
class PipelineConfig:
    step: float = 1.0
    binarize: BinarizeConfig = field(default_factory=BinarizeConfig)
    ahc_threshold: float = 0.6
    vbx: VbxConfig = field(default_factory=VbxConfig)
    merge_gap: float = 0.0
    speaker_keep_threshold: float = 1e-7
    #: score difference below which the previous frame's speakers win; None: plain top-k
    smoothing: float | None = 0.1

    @classmethod
    def for_mode(cls, mode: str) -> PipelineConfig:
        if mode.endswith("-fast"):
            return cls(step=window_step(mode), binarize=BinarizeConfig(min_on=3, min_off=3), vbx=VbxConfig(max_iters=3))
        return cls(step=window_step(mode))
