"""Where tables live: shared folders, segments and manifests, the catalog."""
