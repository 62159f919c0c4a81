"""Readers and writers: files, URIs, chunk store, manifests, legacy packs."""
