"""Analytics over laboratory spectra and the documents that describe them, as Spark plans."""
