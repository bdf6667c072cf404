"""lintlake: code-quality analytics over corpora of files, expressed as Spark plans."""

__version__ = "0.1.0"
