"""Music-document analytics on Spark: page labels, timed notes, playback tables."""
