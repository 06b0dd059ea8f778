"""Source-intake, document-indexing and corpus-preparation engine on Spark."""

__version__ = "0.1.0"
