"""Set-at-a-time operators over many bundles or sessions at once."""
