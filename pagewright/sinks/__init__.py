"""Writers of documents."""
