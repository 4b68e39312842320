"""Fixed values of the signature format: results depend on each of them."""

TARGET_RATE = 11_025
MAX_SOURCE_RATE = 384_000
FRAME_SIZE = 4_096
HOP_SIZE = 1_024
FRAMES_PER_HASH = 8
HASH_STRIDE = 2
PITCH_CLASSES = 12
BAND_LOW_HZ, BAND_HIGH_HZ = 28.0, 3_520.0
TUNING_HZ, TUNING_CLASS = 440.0, 9
DELTA_THRESHOLD = 0.05
RESAMPLER_PHASES, RESAMPLER_LOBES, RESAMPLER_ROLLOFF = 128, 6.0, 0.9
MAX_MP3_BYTES, MAX_MP3_SAMPLES = 128 << 20, 64 << 20
U32_MAX = (1 << 32) - 1
DEFAULT_WINDOW_MS, DEFAULT_INTERVAL_MS = 10_000, 2_000
VERSION = "0.2.0"
