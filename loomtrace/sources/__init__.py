"""Readers and writers of logs, nets, results and event stores."""
