"""Named sources: registries, manifests, files, archives."""
