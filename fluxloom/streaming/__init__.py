"""Running plans: targets that survive replays, micro-batches, and the life of a pipeline."""
