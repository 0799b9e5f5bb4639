"""Plan-level helpers: materialised stages, size-checked broadcasts, distributed prefix sums."""
