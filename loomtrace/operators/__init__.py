"""Relational and replay operators over logs, event stores, nets and workflows."""
