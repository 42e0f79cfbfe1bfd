"""The same rules over streams: a document a row in, findings out, no state."""
