"""Readers and writers of frame, gyro and lens-profile files."""
