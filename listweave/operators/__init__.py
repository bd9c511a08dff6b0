"""Set-oriented steps of a collection run."""
