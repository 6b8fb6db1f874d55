"""Set-based transforms: ``DataFrame -> DataFrame``, lazily, with no driver-side loops over data."""
