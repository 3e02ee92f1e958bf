"""Plans that put operators together: domains, model calls, augmentation and pipelines."""
