"""Readers and writers: lake files, CSV history, quarantine, marts, warehouse tables."""
