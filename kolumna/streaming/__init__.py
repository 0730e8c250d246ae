"""Results in pieces: batches of a finished query, and queries over tables that grow."""

from kolumna.streaming.batches import BATCH, batches, in_turn
from kolumna.streaming.continuous import follow

__all__ = ["BATCH", "batches", "follow", "in_turn"]
