"""Flow analytics on Spark: from captured segments to messages, pairs, events and reports."""
